"""Manifest, quality rules and vector codes: edge cases and plain versions, with the sizes of their blocks set low."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymart.llm import manifest as M, quality_rules as Q, vector_codes as V

ROWS = [
    (1, "The quick Brown fox", "b", "en", 19),
    (2, None, "b", None, None),
    (3, "", "b", "en", 0),
    (None, "No id", "b", "en", 5),
    (None, "No id", "b", "en", 5),
    (-7, "Below zero", "b", "en", 10),
    (4, "Alone", None, "en", 5),
    (5, "É a b c d e f É a b c d e f", "é", "fr", 27),
    (5, "É a b c d e f É a b c d e f", "é", "fr", 27),
    (5, "Another text\nAnother text\n \n#1 $2", "é", "fr", 34),
    (6, "word " * 30_000, "", "en", 150_000),
    (1 << 62, "Far away", "b", "en", 8),
]
CLASH = "g key k m n_ rank_ prefix_ base_ rows_ hash kids leaf root path number words b labelled trusted score bucket".split()


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string, n_chars long")
    return out.select("*", *(F.lit("x").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (5, 1), (None, 1), (3, None), (2, 0)], "doc_id long, quality int")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, folds):
    """The contract row by row: leaves, runs of sixteen, siblings."""

    def leaf(doc_id, text, source, lang, n_chars):
        return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def steps(levels, k):
        for level in levels[:-1]:
            run = level[k // 16 * 16 : k // 16 * 16 + 16]
            yield "".join(run[: k % 16]), "".join(run[k % 16 + 1 :])
            k //= 16

    lower = str.maketrans(M.UPPER, M.LOWER)
    sources = {}
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % folds == 0
        altered = leaf(r[0], r[1] and r[1].translate(lower), *r[2:]) if bad else None
        sources.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf(*r), r[0], altered))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(sources[s], key=lambda x: x[:2])]) for s in order}
    over = tree([trees[s][-1][0] for s in order])
    root, out = over[-1][0], []
    for j, s in enumerate(order):
        for k, (_, own, doc_id, altered) in enumerate(sorted(sources[s], key=lambda x: x[:2])):
            path = [*steps(trees[s], k), *steps(over, j)]
            acc = altered or own
            for left, right in path:
                acc = sha(left, acc, right)
            out.append((doc_id, own, trees[s][-1][0], root, sha(*(a + b for a, b in path)), acc, acc == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_of_odd_rows(docs):
    got = [tuple(r[c] for c in COLUMNS) for r in M.audited(docs, 2).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(ROWS, 2), key=str)
    assert 0 < sum(not x[-1] for x in got) < len(got)
    assert M.audited(docs.limit(0)).collect() == []
    assert all(r["verified"] for r in M.manifest(docs).collect())


@pytest.mark.parametrize(("digit", "bucket"), [(2, 5), (3, 512)])
def test_manifest_by_small_buckets(spark, monkeypatch, digit, bucket):
    monkeypatch.setattr(M, "DIGIT", digit)
    monkeypatch.setattr(M, "BUCKET", bucket)
    r = random.Random(bucket)
    far = [0, 1, -5, 1 << 40, -(1 << 63), (1 << 63) - 1]
    rows = [(r.choice([k, k, k, r.choice(far), None]), f"Text {k % 37}", r.choice(["hot", "hot", f"s{k % 20}", None]), "en", k) for k in range(420)]
    rows += rows[:9]
    got = [tuple(x[c] for c in COLUMNS) for x in M.audited(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long"), 3).collect()]
    assert sorted(got, key=str) == sorted(plain_manifest(rows, 3), key=str)


def test_ranks_equal_a_global_sort(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 3)
    r = random.Random(4)
    keys = sorted({"".join(r.choices("0123", k=r.randrange(1, 7))) for _ in range(300)})
    rows = [(g, k) for g in ("a", "b") for k in keys if g == "a" or r.random() < 0.2]
    got = {(x["g"], x["key"]): (x["rank_"], x["n_"]) for x in M.ranked(spark.createDataFrame(rows, "g string, key string"), "g", "key").collect()}
    for g in ("a", "b"):
        own = sorted(k for h, k in rows if h == g)
        assert {k: got[g, k] for k in own} == {k: (i, len(own)) for i, k in enumerate(own)}
    assert len(got) == len(rows)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = {}
    for i in range(len(words) - 4):
        runs.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + j for at in runs.values() if len(at) > 1 for i in at for j in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in Q.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_of_odd_and_random_texts(spark, docs, labels):
    got = [(r["doc_id"], *(r[c] for c in COUNTS)) for r in Q.judged(docs, labels).collect()]
    assert sorted(got, key=str) == sorted([(r[0], *plain_counts(r[1])) for r in ROWS], key=str)
    assert Q.judged(docs.limit(0), labels).collect() == [] and Q.judged(docs, labels.limit(0)).count() == len(ROWS)
    r = random.Random(1)
    texts = ["".join(r.choices(["a", "b", "ab", "é", "#", "|", "$x", " ", " ", " ", " ", "\n", "\t", "\x0b", "\r", "\x85", "　"], k=r.randrange(120))) for _ in range(400)]
    got = {x["doc_id"]: tuple(x[c] for c in COUNTS) for x in Q.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels).collect()}
    assert got == {k: plain_counts(t) for k, t in enumerate(texts)}


def test_verdicts_against_plain_multinomials(spark):
    r = random.Random(2)
    good, bad = [f"w{k}" for k in range(300)], [f"x{k}!!" for k in range(300)]
    rows = [(k, " ".join(r.choices(good if k % 5 else bad, k=80))) for k in range(200)] + [(None, "short"), (7, "one two")]
    trusted = {k for k in range(0, 200, 2) if k % 5}
    labels = spark.createDataFrame([(k, int(k in trusted)) for k in range(0, 200, 2)], "doc_id long, quality int")
    got = [(x["doc_id"], x["n_words"], x["score"], x["kept"]) for x in Q.judged(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()]

    def buckets(text):
        own = [zlib.crc32(w.encode()) % Q.BUCKETS for w in text.split()]
        return own + [Q.BUCKETS + (a * Q.PAIR + b) % Q.BUCKETS for a, b in zip(own, own[1:], strict=False)]

    raw, target = np.zeros(2 * Q.BUCKETS), np.zeros(2 * Q.BUCKETS)
    for k, t in rows:
        np.add.at(raw, buckets(t), 1)
        if k in trusted and not plain_counts(t)[-1]:
            np.add.at(target, buckets(t), 1)
    ratio = np.rint((np.log(target + Q.PRIOR) - np.log(raw * target.sum() / raw.sum() + Q.PRIOR)) * Q.UNIT)
    want = []
    for k, t in rows:
        n, score = len(t.split()), int(ratio[buckets(t)].sum())
        want.append((k, n, score, not plain_counts(t)[-1] and score >= round(Q.LEAST * Q.UNIT) * (2 * n - 1)))
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = {k for k, _, _, x in got if x}
    assert kept == {k for k in range(200) if k % 5}


def test_rules_use_no_python(docs, labels, monkeypatch):
    plans = []
    monkeypatch.setattr(Q, "stored", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or df)
    plans.append(Q.judged(docs, labels)._jdf.queryExecution().toString())
    assert len(plans) == 3 and not any(re.search("Python|Arrow|Pandas|MapPartitions", p) for p in plans)


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Full scans, entry by entry."""
    kept = sorted((r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.array([[int(np.floor(float(np.float32(x)) * 256)) for x in r[1]] for r in kept]).reshape(len(kept), parts, -1)
    books = v[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        d = ((v[:, :, None] - books[None]) ** 2).sum(axis=3)
        code, error = d.argmin(axis=2), d.min(axis=2).sum(axis=1)
        if k < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = v[code[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(axis=0) // len(own)
    total = {}
    for r, e in zip(kept, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + int(e)
    digest = sha(",".join(map(str, books.reshape(-1).tolist())))
    return [(r[0], "".join(f"{x:02x}" for x in c), int(e), total[r[2]], digest) for r, c, e in zip(kept, code, error, strict=True)]


@pytest.mark.parametrize(("seed", "n", "scale"), [(1, 400, 1.0), (2, 300, 0.01), (3, 20, 1.0), (4, 500, 300.0)])
def test_codes_against_full_scans(spark, seed, n, scale):
    r = np.random.default_rng(seed)
    rows = [(int(k), [float(x) for x in np.round(r.normal(0, scale, 64), 2).astype(np.float32)], int(k) % 3 or None) for k in r.permutation(n)]
    rows += [(None, rows[0][1], 1), (3, rows[1][1], 2), (3, rows[1][1], 2), (n, [0.0] * 64, 1), (n + 1, [-0.001] * 64, 1)]
    bad = [(-1, None, 1), (-2, [None] + [1.0] * 63, 1), (-3, [float("nan")] + [1.0] * 63, 1), (-4, [float("-inf")] * 64, None), (-5, [], 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").select("*", F.lit("x").alias("v"), F.lit("x").alias("state"), F.lit("x").alias("of"))
    got = [(x["vec_id"], x["code"], x["error"], x["label_error"], x["codebooks_sha256"]) for x in V.coded(table).collect()]
    assert sorted(got, key=str) == sorted(plain_codes(rows), key=str)
    assert V.coded(table.limit(0)).collect() == []


def test_bounds_hold_and_spare_distances():
    r = np.random.default_rng(5)
    v = np.concatenate([r.normal(c, 9, (400, 4)) for c in r.normal(0, 300, (40, 4))]).astype(np.int64)
    books = v[r.permutation(len(v))[:64]].copy()
    group = V.groups_of(books)
    best, _, up, low = V.first_assignment(v, books, group)
    spared = []
    for _ in range(6):
        new = books.copy()
        for e in range(64):
            if (best == e).any():
                new[e] = v[best == e].sum(axis=0) // (best == e).sum()
        best, error, up, low, scanned = V.next_assignment(v, new, group, np.sqrt(((new - books) ** 2).sum(axis=1)), best, up, low)
        books = new
        d = ((v[:, None] - books) ** 2).sum(axis=2)
        assert (best == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all() and (up.astype(float) >= np.sqrt(error)).all()
        d = d.astype(float)
        d[np.arange(len(v)), best] = np.inf
        assert all((low[:, g].astype(float) <= np.sqrt(d[:, group == g].min(axis=1))).all() for g in range(group.max() + 1))
        spared.append(1 - scanned / (64 * len(v)))
    assert min(spared) > 0.5


def test_decoded_vectors_have_the_error_that_is_told(spark, sf_dir):
    rows = V.kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    before = {r["vec_id"]: r["v"] for r in rows.collect()}
    codes, books = V.learned(rows)
    error = {r["vec_id"]: r["error"] for r in codes.collect()}
    after = {r["vec_id"]: r["v"] for r in V.decoded(codes, books).collect()}
    assert {k: sum((a - b) ** 2 for a, b in zip(before[k], after[k], strict=True)) for k in before} == error
