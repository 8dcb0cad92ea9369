"""Connected components of an edge table, without collecting anything.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every step is a shuffle of the
edges, their number never grows beyond nodes + edges, and the number of steps
is logarithmic for the shapes met in practice. Each round is written to the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import dropped, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v. ``large``: hang larger neighbours, else smaller ones, on the least.

    Only nodes with a smaller neighbour have a ``least``; the centre of a star
    has none, so its edges pass as they are.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        up = least.select(F.col("u").alias("v"), "m")
        out = edges.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
    else:
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (columns u, v: long), component being its least node.

    Null ends and loops are no edges. Repeated edges and either direction count
    once. Nodes without an edge are not returned; an empty table gives an empty one.
    """
    now = stored(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )
    seen = _print(now)
    while seen[0]:
        new = stored(_star(_star(now, True), False), name)
        found = _print(new)
        dropped(now)
        now = new
        if found == seen:
            break
        seen = found
    own = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
