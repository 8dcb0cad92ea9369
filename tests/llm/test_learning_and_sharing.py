"""Classifiers by recall and ranking of held-out rows of the larger table; chunks that files share."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallymart.llm import media, queries

LARGER = os.environ.get("TEST_LARGER_SF_DIR", "/root/testdata/sf0.1")


def auc(rows):
    """The share of pairs of a 1 and a 0 that scores rank rightly, ties by half."""
    ordered = sorted({s for s, _ in rows})
    below = wrong = 0.0
    for s in ordered:
        ones, zeros = (sum(1 for t, y in rows if t == s and y == k) for k in (1, 0))
        wrong += ones * (below + zeros / 2)
        below += zeros
    n1 = sum(y for _, y in rows)
    return wrong / (n1 * (len(rows) - n1))


# the rarer class, whose recall answering the other one always can't have
@pytest.mark.parametrize(("op", "label", "rare", "recall", "ranked"), [("op5_compression_quality", "quality", 0, 0.7, 0.93), ("op10_toxicity_automata", "toxic", 1, 0.85, 0.93)])
def test_held_out_recall_and_ranking(spark, op, label, rare, recall, ranked):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", F.col(label).cast("int").alias("y"))
    got = queries.queries()[op](spark, LARGER).where("held_out").join(labels, "doc_id").where("y IS NOT NULL").select("score", "predicted", "y").collect()
    own = [r for r in got if r["y"] == rare]
    rest = [r for r in got if r["y"] != rare]
    assert len(own) >= 20
    assert sum(r["predicted"] == rare for r in own) >= recall * len(own)
    assert sum(r["predicted"] != rare for r in rest) >= 0.95 * len(rest)
    assert auc([(r["score"], r["y"]) for r in got]) >= ranked


def test_a_shared_chunk_is_stored_once(spark):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))
    common = text(60_000)
    texts = [text(5_000) + common + text(3_000) for _ in range(6)] + [common, common, text(20_000), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    files, chunks = media.store(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    held = [c["digest"] for c in chunks.collect()]
    assert len(held) == len(set(held))
    within = {r["doc_id"]: r["chunks"] for r in files.collect()}
    uses = {}
    for k, of in within.items():
        for c in of:
            uses.setdefault(bytes(c["digest"]), set()).add(k)
    # the passage is cut alike wherever it lies, and its chunks have no data in the files
    shared = {d for d, ks in uses.items() if set(range(6)) <= ks}
    size = {bytes(c["digest"]): c["size"] for of in within.values() for c in of}
    assert sum(size[d] for d in shared) > 30_000
    assert shared <= {bytes(d) for d in held}
    assert all(c["data"] is None for of in within.values() for c in of if bytes(c["digest"]) in shared)
    assert sum(c["size"] for c in within[8]) == len(media.wave(media.payload_of(texts[8].encode())))


def test_features_by_hand():
    data = bytes(random.Random(3).randrange(256) for _ in range(640))
    signs = [b >= 128 for b in data]
    peaks = [max(data[80 * k : 80 * (k + 1)]) for k in range(8)]
    assert media.features(data) == f"sum={sum(data)};square={sum(b * b for b in data)};crossings={sum(a != b for a, b in zip(signs, signs[1:]))};peaks={','.join(map(str, peaks))}"
