"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a 64-bit hash of the document.
Only a bucket above its byte limit is split, on one more bit, until each shard
fits. Bytes are summed once per round by the next ``ROUND_BITS`` bits of all
buckets still too large, and the splits inside a round are read off the sums of
all their prefixes, so the rows are shuffled as partial sums only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import stored

#: Bits of the hash that a round looks at.
ROUND_BITS = 12
HASH_BITS = 64


def hash_bits(docs: DataFrame) -> F.Column:
    """The first 64 bits of the MD5 of a row's doc_id as text (of its text, where doc_id is null), as text of 0 and 1."""
    key = F.coalesce(docs["doc_id"].cast("string"), docs["text"], F.lit(""))
    return F.lpad(F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, 2), HASH_BITS, "0")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows) for rows with ``bits`` (their hash) and ``n_bytes``.

    ``shard`` is the hash prefix of a bucket. A bucket of one row, or of rows
    with one hash, can't be split and stays whole above the limit.
    """
    wide = rows.select("bits", "n_bytes")
    done = None
    open_ = rows.sparkSession.createDataFrame([("",)], "parent string")
    base = 0
    while True:
        top = min(base + ROUND_BITS, HASH_BITS)
        met = wide.withColumn("parent", F.substring("bits", 1, base)) if base else wide.withColumn("parent", F.lit(""))
        met = met.join(open_, "parent", "left_semi") if base else met
        leaves = met.groupBy(F.substring("bits", 1, top).alias("leaf")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c"))
        # sums of every prefix of every leaf, from the bucket that is still open down to the leaf
        sums = leaves.select(F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"), "leaf", "b", "c")
        sums = sums.groupBy("depth", F.expr("substring(leaf, 1, depth)").alias("shard")).agg(F.sum("b").alias("shard_bytes"), F.sum("c").alias("shard_rows"))
        sums = stored(sums, "shard-sums")
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == HASH_BITS)
        # a bucket exists where its parent doesn't fit; the bucket still open from the last round doesn't
        parents = sums.where(~fits).select((F.col("depth") + 1).alias("pd"), F.col("shard").alias("ps"))
        split = sums.where(F.col("depth") > base).join(parents, (F.col("depth") == F.col("pd")) & (F.expr("substring(shard, 1, depth - 1)") == F.col("ps")), "left_semi")
        whole = sums.where(F.col("depth") == 0) if base == 0 else sums.limit(0)
        found = whole.unionByName(split).where(fits)
        done = found if done is None else done.unionByName(found)
        if top == HASH_BITS:
            return done.select("shard", "depth", "shard_bytes", "shard_rows")
        open_ = sums.where((F.col("depth") == top) & ~fits).select(F.col("shard").alias("parent"))
        if open_.isEmpty():
            return done.select("shard", "depth", "shard_bytes", "shard_rows")
        base = top


def sharded(docs: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """Per row: doc_id, n_bytes (of the text in UTF-8), shard (hash prefix as text of 0 and 1), depth, shard_bytes, shard_rows.

    Every shard holds ``limit`` bytes at most, unless rows with one hash alone
    are larger: a text above the limit is a shard of its own, and so are rows
    that repeat one doc_id. Null or empty text: 0 bytes. Rows with a null doc_id
    are hashed by their text. If all fits one shard, its prefix is empty. An
    empty table gives an empty table; other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(docs).alias("bits"))
    rows = stored(rows, "shard-rows")
    return _placed(rows, stored(directory(rows, limit), "shard-directory")).select("doc_id", "n_bytes", "s.*")


def _placed(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows (with ``bits``) and ``s``, their shard: the one prefix of their hash that is in the directory.

    The directory is grouped by as many bits as its shallowest shard has, so
    each row is joined once; a group holds the few shards that were split further.
    """
    least = shards.agg(F.min("depth")).first()[0] or 0
    groups = shards.groupBy(F.expr(f"substring(shard, 1, {least})").alias("prefix")).agg(F.collect_list(F.struct("shard", "depth", "shard_bytes", "shard_rows")).alias("own"))
    met = rows.withColumn("prefix", F.expr(f"substring(bits, 1, {least})")).join(groups, "prefix")
    return met.withColumn("s", F.get(F.filter("own", lambda s: F.col("bits").startswith(s["shard"])), F.lit(0))).drop("prefix", "own")


def write_shards(docs: DataFrame, path: str, limit: int = 1 << 20) -> DataFrame:
    """Write ``docs`` as one Parquet folder per shard below ``path`` (column ``shard``); the directory is returned.

    Every row is written once, rows with a null doc_id or a repeated one too. A
    column ``shard`` of ``docs`` would clash and is an error; other names don't.
    """
    if "shard" in docs.columns:
        raise ValueError("rename the column shard")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = stored(docs.select(F.struct("*").alias("row"), size.alias("n_bytes"), hash_bits(docs).alias("bits")), "shard-rows")
    shards = stored(directory(rows, limit), "shard-directory")
    placed = _placed(rows, shards).select("row.*", F.concat(F.lit("p"), "s.shard").alias("shard"))
    placed.repartition("shard").write.partitionBy("shard").parquet(path)
    return shards


#: DuckDB SQL for :func:`sharded` at a limit of 1 MiB.
ORACLE = """
WITH r AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         right(repeat('0', 64) || bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 16))::UBIGINT), 64) AS bits
  FROM documents),
p AS (SELECT r.*, d::INT AS depth, substr(bits, 1, d::INT) AS shard FROM r, range(0, 65) AS g(d)),
t AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM p GROUP BY depth, shard),
o AS (SELECT p.doc_id, p.n_bytes, p.bits, min(p.depth) AS depth FROM p JOIN t USING (depth, shard)
      WHERE shard_bytes <= 1048576 OR shard_rows = 1 OR depth = 64 GROUP BY ALL)
SELECT o.doc_id, o.n_bytes, t.shard, t.depth, t.shard_bytes, t.shard_rows
FROM o JOIN t ON t.depth = o.depth AND t.shard = substr(o.bits, 1, o.depth)
"""
