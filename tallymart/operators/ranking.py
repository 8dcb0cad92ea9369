"""Latest price, best match, and other first-of-group selections, all with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Match statuses, best first.
STATUS_ORDER = ("confirmed", "auto_matched", "needs_review", "low_confidence", "rejected")
LINKED = ("confirmed", "auto_matched")


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group, with all their columns; Spark prunes below the shuffle by a window group limit."""
    rank = free_name(df, "_rank")
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n).drop(rank)


def latest_price(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each listing."""
    return first_of(snapshots, ["listing_id"], [F.desc("captured_at"), F.desc("order_id"), F.desc("line_no"), F.desc("tie")])


def status_rank(status: Column) -> Column:
    """Position of a status in the order, unknown ones last."""
    out = F.lit(len(STATUS_ORDER))
    for k, s in reversed(list(enumerate(STATUS_ORDER))):
        out = F.when(status == s, F.lit(k)).otherwise(out)
    return out


def best_match(matches: DataFrame, include_rejected: bool = False, scope: DataFrame | None = None) -> DataFrame:
    """The best match of each listing by status, then score, then product.

    ``scope`` (listing_id) is applied below the window, so that only its matches are ranked.
    """
    rows = matches if include_rejected else matches.where(F.col("status") != "rejected")
    if scope is not None:
        rows = rows.join(scope, "listing_id", "left_semi")
    return first_of(rows, ["listing_id"], [status_rank(F.col("status")), F.desc("match_score"), F.asc("product_id")])


def best_match_legacy(matches: DataFrame) -> DataFrame:
    """As :func:`best_match`, but all statuses below needs_review count the same."""
    rank = F.when(F.col("status") == "confirmed", 0).when(F.col("status") == "auto_matched", 1).when(F.col("status") == "needs_review", 2).otherwise(3)
    return first_of(matches, ["listing_id"], [rank, F.desc("match_score"), F.asc("product_id")])
