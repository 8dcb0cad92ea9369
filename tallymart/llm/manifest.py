"""Merkle manifest of a dataset: one hash tree per source, one over the sources.

Leaves of a source ascend by doc_id, and every sixteen of them make a node. The
place of a leaf is found without a global sort: histograms over the digits of
its key, refined only where a bucket is still large, give the rank at which its
bucket begins, and the few rows of a bucket are numbered. The base-16 digits of
a rank are then the leaf's path in a trie: nodes are keyed by a prefix of it and
made from the longest prefix up. On the way down every node hands its children
the siblings that a proof needs, so no row meets more than its fifteen siblings.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymart.llm.common import stored

#: Children of a node.
FANOUT = 16
#: Characters of a key that a histogram looks at, and rows below which a bucket is numbered as it is.
DIGIT, BUCKET = 2, 512


def framed(value: Column) -> Column:
    """``-`` for null, else the number of bytes of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    """The SHA-256 of a document with this text."""
    return F.sha2(F.concat(*(framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), framed(text)), 256)


def ranked(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with rank_ (from 0, by ``key`` within ``group``) and n_ (rows of the group), without a global sort.

    ``key`` is text whose order by bytes is the order wanted and which no two
    rows of a group share; ``group`` isn't null. A bucket is a prefix of the
    key: those above ``BUCKET`` rows are split by ``DIGIT`` more characters.
    """
    ends = rows.agg(F.min(key), F.max(key)).first()
    depth = len(os.path.commonprefix([x or "" for x in ends]))
    cells = rows.groupBy(group).agg(F.count("*").alias("rows_")).select(group, F.lit((ends[0] or "")[:depth]).alias("prefix_"), "rows_", F.col("rows_").alias("n_"), F.lit(0).cast("long").alias("base_"))
    found, depths = None, []
    while True:
        cells = stored(cells, "manifest-histogram")
        closed, open_ = cells.where(F.col("rows_") <= BUCKET), cells.where(F.col("rows_") > BUCKET)
        if not closed.isEmpty():
            closed = closed.withColumn("depth_", F.lit(depth))
            found = closed if found is None else found.unionByName(closed)
            depths.append(depth)
        if open_.isEmpty():
            break
        parent = F.substring("prefix_", 1, depth).alias("parent_")
        finer = rows.groupBy(group, F.substring(key, 1, depth + DIGIT).alias("prefix_")).agg(F.count("*").alias("rows_")).withColumn("parent_", parent)
        finer = finer.join(open_.select(group, F.col("prefix_").alias("parent_"), "n_", "base_"), [group, "parent_"])
        before = Window.partitionBy(group, "parent_").orderBy("prefix_").rowsBetween(Window.unboundedPreceding, -1)
        cells = finer.select(group, "prefix_", "rows_", "n_", (F.col("base_") + F.coalesce(F.sum("rows_").over(before), F.lit(0))).alias("base_"))
        depth += DIGIT
    if found is None:
        return rows.withColumns({"rank_": F.lit(0).cast("long"), "n_": F.lit(0).cast("long")}).limit(0)
    # a row has one prefix in each depth, and one of them is a bucket
    met = rows.withColumn("depth_", F.explode(F.array(*map(F.lit, depths)))).withColumn("prefix_", F.expr(f"substring({key}, 1, depth_)"))
    met = met.join(found.select(group, "depth_", "prefix_", "base_", "n_"), [group, "depth_", "prefix_"])
    number = F.row_number().over(Window.partitionBy(group, "depth_", "prefix_").orderBy(key))
    return met.withColumn("rank_", F.col("base_") + number - 1).drop("depth_", "prefix_", "base_")


def _steps(kids: Column, digit: Column) -> Column:
    """The siblings of child ``digit`` among ``kids``: those before it and those after it, each joined."""
    hashes = F.transform(kids, lambda x: x["hash"])
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), digit), "").alias("left"), F.array_join(F.slice(hashes, digit + 2, F.lit(FANOUT)), "").alias("right"))


NO_STEPS = "cast(array() as array<struct<left: string, right: string>>)"


def levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The trie's levels from the leaves' parents up: g, k (the rank's prefix), m (nodes of the group here), hash, kids, alone.

    ``leaves``: g, rank_, n_, hash and ``item``, which stays with its leaf. A
    group of one leaf has no node: its entry at the first level is marked alone
    and has the leaf's hash.
    """
    most = leaves.agg(F.max("n_")).first()[0] or 0
    join = F.sha2(F.array_join(F.transform("kids", lambda x: x["hash"]), ""), 256)
    digit = (F.col("rank_") % FANOUT).cast("int").alias("digit")
    up = leaves.groupBy("g", F.expr(f"rank_ div {FANOUT}").alias("k"), "n_").agg(F.array_sort(F.collect_list(F.struct(digit, "hash", "item"))).alias("kids"))
    up = up.select("g", "k", F.expr(f"(n_ + {FANOUT - 1}) div {FANOUT}").alias("m"), (F.col("n_") == 1).alias("alone"), "kids")
    found = [stored(up.withColumn("hash", F.when(F.col("alone"), F.col("kids")[0]["hash"]).otherwise(join)), name)]
    while most > FANOUT:
        most = -(-most // FANOUT)
        below = found[-1].where("m > 1")
        up = below.groupBy("g", F.expr(f"k div {FANOUT}").alias("up"), "m").agg(F.array_sort(F.collect_list(F.struct((F.col("k") % FANOUT).cast("int").alias("digit"), "hash"))).alias("kids"))
        up = up.select("g", F.col("up").alias("k"), F.expr(f"(m + {FANOUT - 1}) div {FANOUT}").alias("m"), F.lit(False).alias("alone"), "kids")
        found.append(stored(up.withColumn("hash", join), name))
    return found


def tops(found: list[DataFrame]) -> DataFrame:
    """(g, hash): the root of each group."""
    out = found[0].where("m = 1").select("g", "hash")
    for x in found[1:]:
        out = out.unionByName(x.where("m = 1").select("g", "hash"))
    return out


def descended(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first level with ``path``, the siblings from there up, and the other columns of ``above`` (g, path, ...: what lies above a group's root)."""
    more = [c for c in above.columns if c not in ("g", "path")]
    down = None
    for x in reversed(found):
        rows = x.where("m = 1").join(above, "g")
        if down is not None:
            parents = down.select("g", F.col("k").alias("up"), F.col("kids").alias("up_kids"), F.col("path").alias("up_path"), *more)
            met = x.where("m > 1").withColumn("up", F.expr(f"k div {FANOUT}")).join(parents, ["g", "up"])
            step = _steps(F.col("up_kids"), (F.col("k") % FANOUT).cast("int"))
            rows = rows.unionByName(met.withColumn("path", F.concat(F.array(step), F.col("up_path"))).drop("up", "up_kids", "up_path"))
        down = rows
    return down


def proved(first: DataFrame) -> DataFrame:
    """One row per leaf of a level with paths: item, hash, steps (its siblings level by level to the top) and the other columns."""
    out = first.select("*", F.explode("kids").alias("kid"))
    own = F.when(F.col("alone"), F.expr(NO_STEPS)).otherwise(F.array(_steps(F.col("kids"), F.col("kid.digit"))))
    rest = [c for c in first.columns if c not in ("k", "m", "alone", "hash", "kids", "path")]
    return out.select(*rest, "kid.item", F.col("kid.hash").alias("hash"), F.concat(own, "path").alias("steps"))


def manifest(docs: DataFrame, spoiled: Column | None = None, spoiled_text: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``spoiled`` says which rows arrive tampered with (none by default) and
    ``spoiled_text`` what their text is then; their proof is folded from the
    leaf of that text, all others from their own. Null source: a source of its
    own, before the others. Null doc_id: before the others of its source. Rows
    that repeat a doc_id stand by their leaf; equal rows have equal results up
    to which of them is at which place. Null and empty texts have different
    leaves. One source, or one row: fewer levels. An empty table gives an empty
    table; other columns aren't read.
    """
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    bad = F.lit(False) if spoiled is None else F.coalesce(spoiled, F.lit(False))
    altered = F.when(bad, F.unhex(leaf_hash(F.col("text") if spoiled_text is None else spoiled_text)))
    rows = doc.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("g"), F.unhex(leaf_hash(F.col("text"))).alias("leaf"), altered.alias("altered"))
    # the number of a row tells apart those that are equal; it is written, so it stays
    rows = stored(rows.withColumn("number", F.monotonically_increasing_id()), "manifest-leaves")
    wide = lambda c: F.lpad(F.hex(c), 16, "0")
    place = F.coalesce(F.concat(F.lit("1"), wide(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))))), F.lit("0"))
    placed = ranked(rows.withColumn("key", F.concat(place, F.hex("leaf"), wide(F.col("number")))), "g", "key")
    of_source = levels(placed.select("g", "rank_", "n_", F.lower(F.hex("leaf")).alias("hash"), F.struct("doc_id", "altered").alias("item")), "manifest-level")

    subroots = stored(tops(of_source).select(F.col("g").alias("source"), "hash", F.lit("all").alias("g"), F.hex("g").alias("key")), "manifest-subroots")
    over = levels(ranked(subroots, "g", "key").select("g", "rank_", "n_", "hash", F.struct("source").alias("item")), "manifest-top")
    root = tops(over).select("g", F.col("hash").alias("root"), F.expr(NO_STEPS).alias("path"))
    above = proved(descended(over, root)).select(F.col("item.source").alias("g"), F.col("hash").alias("subroot"), "root", F.col("steps").alias("path"))

    leaves = proved(descended(of_source, above))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    start = F.coalesce(F.lower(F.hex("item.altered")), F.col("hash"))
    folded = F.aggregate("steps", start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
    out = leaves.select(F.col("item.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audited(docs: DataFrame, folds: int = 5) -> DataFrame:
    """:func:`manifest` where the rows with crc32(doc_id as text) divisible by ``folds`` arrive with the A-Z of their text lower-cased."""
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.translate("text", UPPER, LOWER))


def _crc_macro() -> str:
    """DuckDB SQL: ``crc32_(s)`` of an ASCII text, bit by bit over a list of its bytes."""
    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda x, j: {bit})), 4294967295)"


def _framed(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


def _nodes(name: str, leaves: str) -> str:
    """SQL of the nodes of all levels over a table (g, k, n, h), with what stands left and right of each among its siblings."""
    return f"""
{name}_n AS (SELECT g, 0 AS l, k, n, h FROM {leaves}
  UNION ALL SELECT g, l + 1, k // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY k)) FROM {name}_n WHERE n > 1 GROUP BY g, l, k // 16),
{name} AS (SELECT *, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
  coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM {name}_n WINDOW w AS (PARTITION BY g, l, k // 16 ORDER BY k))"""


#: DuckDB SQL for :func:`audited`.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, doc_id::VARCHAR AS s, {" || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM documents),
h AS (SELECT doc_id, source, sha256(head || {_framed("text")}) AS h,
        CASE WHEN {_crc_macro()} % 5 = 0 THEN sha256(head || {_framed(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS altered FROM d),
o AS (SELECT *, coalesce('=' || source, '') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM h),
{_nodes("t", "o")},
s AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS n, h, g AS source FROM t WHERE n = 1),
{_nodes("u", "s")},
v AS (SELECT 0 AS stage, g, l, k, n, lft, rgt FROM t UNION ALL SELECT 1, '', l, k, n, lft, rgt FROM u),
f AS (SELECT row_number() OVER () AS r, doc_id, g, 0 AS stage, 0 AS l, k, h AS leaf, coalesce(altered, h) AS acc, '' AS proof FROM o
  UNION ALL
  SELECT f.r, f.doc_id, f.g, CASE WHEN v.n = 1 THEN f.stage + 1 ELSE f.stage END, CASE WHEN v.n = 1 THEN 0 ELSE f.l + 1 END,
         CASE WHEN v.n > 1 THEN f.k // 16 ELSE s.k END, f.leaf,
         CASE WHEN v.n = 1 THEN f.acc ELSE sha256(v.lft || f.acc || v.rgt) END, CASE WHEN v.n = 1 THEN f.proof ELSE f.proof || v.lft || v.rgt END
  FROM f JOIN s ON s.source = f.g JOIN v ON v.stage = f.stage AND v.g = CASE WHEN f.stage = 0 THEN f.g ELSE '' END AND v.l = f.l AND v.k = f.k)
SELECT f.doc_id, f.leaf, t.h AS subroot, u.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = u.h AS verified
FROM f JOIN t ON f.stage = 2 AND t.g = f.g AND t.n = 1 JOIN u ON u.n = 1
"""
