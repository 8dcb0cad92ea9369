"""Discovery of products as a stream: micro-batches of URLs against a keyed store of what is known.

A listing is known by its URL and, where it has one, by its product code, so the
store has a row for each. A batch reads only the buckets of its own keys. New
listings and categories for known ones go in with one commit under the batch's
number; a batch that is delivered again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.operators.ranking import first_of
from tallymart.sources.keyed_table import KeyedTable
from tallymart.sources.scratch import dropped, kept

SCHEMA = "site long, key string, url string, code string, category string, batch long"
KEY = ("site", "key")


def store(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, path, SCHEMA, KEY, buckets)


def keyed(items: DataFrame, batch: int) -> DataFrame:
    """A row for the URL of each item (site, url, code, category) and one for its code."""
    keys = F.array_compact(F.array(F.concat(F.lit("u:"), "url"), F.when(F.col("code").isNotNull(), F.concat(F.lit("c:"), "code"))))
    return items.select("site", F.explode(keys).alias("key"), "url", "code", "category", F.lit(batch).cast("long").alias("batch"))


def discover(table: KeyedTable, items: DataFrame, batch: int, source: str = "discovery") -> bool:
    """Put the unknown ones of ``items`` (site, url, code, category) into the store; False if the batch was applied before.

    An item is known if its URL or its code is. Items of one URL, and then of one
    code, count once: that with a code, the least one, and the least URL. A known
    listing without a category takes that of the item. Items without a URL are
    passed over; a null site is a site.
    """
    one = first_of(items.where("url IS NOT NULL"), ["site", "url"], [F.asc_nulls_last("code"), F.asc_nulls_last("category")])
    coded = first_of(one.where("code IS NOT NULL"), ["site", "code"], [F.asc("url")])
    # each step is written once, as the store reads it for its buckets and again for its rows
    one = kept(one.where("code IS NULL").unionByName(coded), "items")
    if not table.manifest().get("folders"):
        done = table.merge(keyed(one, batch), lambda old, new: new, source, batch)
        dropped(one)
        return done
    asked = keyed(one, batch)
    known = table.of(asked.select(*KEY)).select("site", "key", F.col("url").alias("own"), F.col("code").alias("own_code"))
    same = F.col("a.site").eqNullSafe(F.col("k.site")) & (F.col("a.key") == F.col("k.key"))
    met = asked.alias("a").join(known.alias("k"), same, "left").groupBy("a.site", "a.url", "a.code", "a.category").agg(F.max_by(F.struct("k.own", "k.own_code"), F.when(F.col("k.own").isNotNull(), F.col("a.key"))).alias("found"))
    new = keyed(met.where("found IS NULL OR found.own IS NULL").select("site", "url", "code", "category"), batch)
    filled = keyed(met.where("found.own IS NOT NULL AND category IS NOT NULL").select("site", F.col("found.own").alias("url"), F.col("found.own_code").alias("code"), "category"), batch)
    changes = kept(new.unionByName(first_of(filled, list(KEY), [F.asc("category")])), "changes")

    def combine(old: DataFrame, changes: DataFrame) -> DataFrame:
        both = old.alias("o").join(changes.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in KEY], "full_outer")
        first = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
        return both.select(*map(first, ("site", "key", "url", "code", "category", "batch")))

    done = table.merge(changes, combine, source, batch)
    dropped(one)
    dropped(changes)
    return done


def discovery_stream(items: DataFrame, table: KeyedTable, checkpoint: str, source: str = "discovery"):
    """A query that puts each micro-batch of a stream of items into the store, until the stream has no more; of the store's versions only the latest stays."""

    def put(rows: DataFrame, k: int) -> None:
        if discover(table, rows, k, source):
            table.forget()

    return items.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listings(table: KeyedTable) -> DataFrame:
    """(site, url, code, category, batch) of all listings in the store."""
    return table.read().where(F.col("key").startswith("u:")).select("site", "url", "code", "category", "batch")
