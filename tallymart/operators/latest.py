"""The latest snapshot of each listing as a kept table, moved forward by what is new instead of ranked from all history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.operators.ranking import latest_price
from tallymart.sources.keyed_table import KeyedTable
from tallymart.sources.scratch import dropped, kept

ORDER = ("captured_at", "order_id", "line_no", "tie")
MARK = "captured_at"


def latest_table(snapshots: DataFrame, path: str, buckets: int = 16) -> KeyedTable:
    """The table of the latest snapshots at ``path``, empty at first."""
    return KeyedTable(snapshots.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in snapshots.schema), ("listing_id",), buckets)


def increment(table: KeyedTable, snapshots: DataFrame, lateness: int = 0) -> DataFrame:
    """The snapshots from the watermark on, less ``lateness`` seconds; all of them for a new table. The bound reaches the scan."""
    mark = table.manifest().get("marks", {}).get(MARK)
    if mark is None:
        return snapshots
    return snapshots.where((F.col("captured_at") >= F.timestamp_micros(F.lit(mark - lateness * 1_000_000))) | F.col("captured_at").isNull())


def advance(table: KeyedTable, snapshots: DataFrame, lateness: int = 0) -> bool:
    """Bring the table up to the snapshots; False if none is newer than what it has.

    Only the increment is ranked, and only the buckets of listings with a newer
    snapshot are rewritten. Snapshots later than ``lateness`` behind the newest
    one seen before are not looked at again; those at the watermark are, and
    change nothing if they were there. Snapshots without a time come before all.
    """
    # ranked once; the table's buckets and the watermark are then read from what is new, not from all snapshots again
    new = kept(latest_price(increment(table, snapshots, lateness)), "newest")
    try:
        return _moved(table, new)
    finally:
        dropped(new)


def _moved(table: KeyedTable, new: DataFrame) -> bool:
    """Put the latest ones of an increment into the table where they are newer; False if none is."""
    fresh = not table.manifest().get("folders")
    newer = new
    if not fresh:
        old = table.of(new.select("listing_id")).select(F.col("listing_id").alias("of_"), F.struct(*ORDER).alias("had_"))
        newer = new.join(old, new["listing_id"].eqNullSafe(old["of_"]), "left").where(F.col("had_").isNull() | (F.struct(*ORDER) > F.col("had_"))).drop("of_", "had_")
    top = newer.agg(F.unix_micros(F.max(F.col("captured_at").cast("timestamp"))).alias("top"), F.count("*").alias("n")).first()
    if not top["n"]:
        return False
    mark = max(x for x in (top["top"], table.manifest().get("marks", {}).get(MARK), -(1 << 62)) if x is not None)
    return table.merge(newer, lambda had, got: got if fresh else latest_price(had.unionByName(got.select(*had.columns))), marks={MARK: mark})
