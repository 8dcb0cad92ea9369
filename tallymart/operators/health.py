"""URL health: failure streaks that mark a listing dead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUTS_DEAD, NOT_FOUND_DEAD = 3, 2


def fold(outcomes: DataFrame, carry: tuple[int, int, bool] = (0, 0, False)) -> DataFrame:
    """(listing_id, timeouts, not_found, is_dead) after all outcomes in the order of time and event.

    Success zeroes both streaks but revives nothing; a timeout zeroes the other
    streak and the reverse; a missing price zeroes the timeouts alone; other
    codes change nothing. A listing's history is folded in one row, so it must
    fit a task; for endless histories use the streaming form, which keeps three
    values for each listing.
    """
    ordered = F.array_sort(F.collect_list(F.struct("captured_at", "event_id", "outcome", "error_code")))
    state = F.struct(F.lit(carry[0]).alias("t"), F.lit(carry[1]).alias("n"), F.lit(carry[2]).alias("d"))

    def step(s, e):
        code = F.coalesce(e["error_code"], F.lit(""))
        done, late, gone = e["outcome"] == "scraped", code == "playwright_timeout", code == "product_not_found"
        t = F.when(done, 0).when(late, s["t"] + 1).when(gone | (code == "price_not_found"), 0).otherwise(s["t"])
        n = F.when(done, 0).when(late, 0).when(gone, s["n"] + 1).otherwise(s["n"])
        dead = s["d"] | (~done & late & (t >= TIMEOUTS_DEAD)) | (~done & gone & (n >= NOT_FOUND_DEAD))
        return F.struct(t.cast("int").alias("t"), n.cast("int").alias("n"), dead.alias("d"))

    out = outcomes.groupBy("listing_id").agg(F.aggregate(ordered, state, step).alias("s"))
    return out.select("listing_id", F.col("s.t").alias("timeouts"), F.col("s.n").alias("not_found"), F.col("s.d").alias("is_dead"))


def streaks(outcomes: DataFrame) -> DataFrame:
    """(listing_id, longest): the longest run of failures, by gaps and islands."""
    from pyspark.sql import Window as W

    order = [F.asc("captured_at"), F.asc("event_id")]
    w = W.partitionBy("listing_id").orderBy(*order)
    runs = outcomes.withColumn("a", F.row_number().over(w)).withColumn("b", F.row_number().over(W.partitionBy("listing_id", "outcome").orderBy(*order)))
    runs = runs.where("outcome = 'failed'").groupBy("listing_id", (F.col("a") - F.col("b")).alias("run")).agg(F.count("*").alias("n"))
    return runs.groupBy("listing_id").agg(F.max("n").alias("longest"))


def breaker(outcomes: DataFrame, codes: tuple[str, ...], most: int = 15) -> DataFrame:
    """(listing_id, event_id) of the first event at which ``most`` outcomes in a row had one of the codes: there a run stops."""
    from pyspark.sql import Window as W

    w = W.partitionBy("listing_id").orderBy("captured_at", "event_id")
    bad = F.coalesce(F.col("error_code").isin(*codes), F.lit(False))
    runs = outcomes.withColumn("_bad", bad).withColumn("_run", F.sum(F.when(bad, 0).otherwise(1)).over(w))
    # the first row of a run but the first is the good outcome that began it
    place = F.sum(F.col("_bad").cast("int")).over(W.partitionBy("listing_id", "_run").orderBy("captured_at", "event_id"))
    hits = runs.withColumn("_n", place).where(F.col("_bad") & (F.col("_n") == most))
    return hits.groupBy("listing_id").agg(F.min_by("event_id", F.struct("captured_at", "event_id")).alias("event_id"))
