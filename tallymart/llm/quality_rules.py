"""Rules of text quality: counts of a text, and how much likelier its n-grams are in trusted texts than in the corpus.

Words and pairs of words are hashed into buckets, and two multinomials over the
buckets are counted, one from texts labelled good and one from all of them. A
text's verdict is the mean log-likelihood ratio of its n-grams (Xie et al.,
"Data Selection for Language Models via Importance Resampling", 2023, without
the resampling: every document is kept or not by a threshold). Ratios are rounded
to millionths before they are summed, so that sums are whole numbers and no
order of rows changes a verdict.

Everything is built-in expressions. A text is parted into words once; what the
counts and the scores need of it is a table of small integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import stored

#: White space between words, and characters counted as symbols.
BREAKS, SYMBOLS = "\t\n\x0b\x0c\r", "#*$%&|<>"
#: Buckets of words and again of pairs; what every bucket counts at least; unit of a ratio; the least mean ratio of a kept text.
BUCKETS, PRIOR, UNIT, LEAST = 1 << 15, 5, 1_000_000, -0.15
#: Odd multiplier that tells the first word of a pair from the second.
PAIR = 12_583
WINDOW = 5


def words(text: Column) -> Column:
    """The runs of characters between white space."""
    for c in BREAKS:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many words, given by their hashes, lie in runs of ``window`` that the text has twice or more, the first included."""

    def covered(runs: Column) -> Column:
        by_hash = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _once(by_hash, lambda pairs: _once(F.sort_array(F.transform(F.filter(pairs, lambda p, k: _twin(pairs, p, k)), lambda p: p["i"])), _union))

    def _twin(pairs: Column, p: Column, k: Column) -> Column:
        same = lambda j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
        return same(k - 1) | same(k + 1)

    def _union(starts: Column) -> Column:
        none = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        step = lambda s, i: F.struct((s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"), i.alias("last"))
        return F.aggregate(starts, none, step, lambda s: s["n"])

    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window))))
    count = _once(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(covered(r)))
    return F.when(F.size(hashes) <= window, F.lit(0)).otherwise(count).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BREAKS + " "))) > 0)
    count = _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return F.when(F.contains(text, F.lit("\n")), count).otherwise(F.lit(0)).cast("long")


def pair_bucket(first: Column, second: Column) -> Column:
    """BUCKETS to 2 * BUCKETS - 1, from the buckets of two words."""
    return F.lit(BUCKETS) + (first * PAIR + second) % BUCKETS


def counted(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and ``b``, the bucket (from 0) of each word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.crc32(w.cast("binary"))))
    n, symbols = F.size("words").cast("long"), F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long")
    out = rows.select("doc_id", n.alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), symbols.alias("n_symbols"), dup_lines(F.col("text")).alias("n_dup_lines"), repeated_words(F.col("hashes")).alias("n_repeat_words"), F.transform("hashes", lambda h: (h % BUCKETS).cast("short")).alias("b"))
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def exploded(rows: DataFrame, *more: str) -> DataFrame:
    """One row per word: ``own``, its bucket, and ``pair``, that of it and the next word (null at the last), beside the columns ``more``."""
    following = F.slice("b", F.lit(2), F.size("b"))
    out = rows.select(*more, F.explode(F.arrays_zip(F.col("b").alias("x"), following.alias("y"))).alias("w"))
    own, after = F.col("w.x").cast("int"), F.col("w.y").cast("int")
    return out.select(*more, own.alias("own"), pair_bucket(own, after).alias("pair"))


def ratios(rows: DataFrame) -> DataFrame:
    """(bucket, ratio): millionths of the log of how much likelier a bucket is in the rows that are ``trusted``, for every bucket that occurs.

    Both multinomials have ``PRIOR`` added to each bucket once they are brought
    to the size of the trusted one, so what is rare says little.
    """
    both = exploded(rows, "trusted").select("trusted", F.explode(F.array("own", "pair")).alias("bucket")).where("bucket IS NOT NULL")
    counts = stored(both.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("good")), "ngram-counts")  # 2 * BUCKETS rows at most
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    if not total["raw"]:
        return counts.select("bucket", F.lit(0).cast("long").alias("ratio"))
    expected = F.col("raw").cast("double") * F.lit(float(total["good"])) / F.lit(float(total["raw"]))
    return counts.select("bucket", F.round((F.log(F.col("good") + F.lit(float(PRIOR))) - F.log(expected + F.lit(float(PRIOR)))) * UNIT).cast("long").alias("ratio"))


def judged(docs: DataFrame, labels: DataFrame, least: float = LEAST) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    ``score`` is the sum of the ratios of the row's words and pairs in
    millionths; the row is kept if it doesn't fail the base rules and the sum is
    at least ``least`` times their number. Trusted are the rows whose doc_id has
    a label ``quality`` 1 and that don't fail the base rules; without any, all
    ratios are 0 and the base rules decide. Null and empty texts have no words
    and fail. Null doc_id: never trusted. Repeated rows and labels: each row is
    counted and judged, a label once. Long texts are judged whole. An empty
    table gives an empty table; other columns aren't read.
    """
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("labelled", F.lit(True))
    # one plan at every size: labels grow with the corpus, so they are never broadcast
    rows = counted(docs).join(trusted.hint("merge"), "doc_id", "left")
    rows = rows.withColumn("trusted", F.coalesce("labelled", F.lit(False)) & ~F.col("base_failed")).drop("labelled")
    # the number of a row tells apart those of one doc_id; it is written, so it stays
    rows = stored(rows.withColumn("number", F.monotonically_increasing_id()), "quality-rules")
    found = {r["bucket"]: r["ratio"] for r in ratios(rows).collect()}  # at most 2 * BUCKETS numbers
    table = F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(2 * BUCKETS))), ",").cast("array<long>")  # folded to a constant
    ratio = F.get(table, F.col("own")) + F.coalesce(F.get(table, F.col("pair")), F.lit(0))
    scores = exploded(rows, "number").groupBy("number").agg(F.sum(ratio).alias("found"))
    score = F.coalesce("found", F.lit(0)).alias("score")
    out = rows.drop("b").join(scores, "number", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", score)
    bound = F.lit(round(least * UNIT)) * F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= bound))


def _crc_steps() -> str:
    """The 256 values that CRC-32 takes from its polynomial, as a DuckDB list."""
    out = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return f"{out}::BIGINT[]"


#: DuckDB SQL for :func:`judged`.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
e AS MATERIALIZED (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, CASE WHEN i + 4 <= max(i) OVER (PARTITION BY r) THEN [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] END AS f FROM e WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i FROM g WHERE f IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, f) > 1),
p AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM t, range(0, 5) AS x(j) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
b AS MATERIALIZED (SELECT w.r, w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(p.n_repeat_words, 0)::BIGINT AS n_repeat_words
       FROM w LEFT JOIN l USING (r) LEFT JOIN p USING (r)),
f AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
z AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM e)),
y AS MATERIALIZED (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT)),
  lambda a, c: xor(a >> 8, ({_crc_steps()})[xor(a, c) % 256 + 1]))) % {BUCKETS} AS h FROM z),
h AS MATERIALIZED (SELECT r, i, h FROM e JOIN y USING (word)),
n AS MATERIALIZED (SELECT r, h AS bucket FROM h UNION ALL
  SELECT r, {BUCKETS} + (h * {PAIR} + nxt) % {BUCKETS} FROM (SELECT r, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS nxt FROM h) WHERE nxt IS NOT NULL),
good AS (SELECT r FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
c AS (SELECT bucket, count(*)::DOUBLE AS raw, count(good.r)::DOUBLE AS good FROM n LEFT JOIN good USING (r) GROUP BY bucket),
q AS (SELECT bucket, round((ln(good + {PRIOR}) - ln(raw * (sum(good) OVER ()) / (sum(raw) OVER ()) + {PRIOR})) * {UNIT})::BIGINT AS ratio FROM c),
s AS (SELECT r, sum(ratio)::BIGINT AS score FROM n JOIN q USING (bucket) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(score, 0) >= {round(LEAST * UNIT)} * greatest(2 * n_words - 1, 0) AS kept, coalesce(score, 0) AS score
FROM f LEFT JOIN s USING (r)
"""
