"""A feed cut into pages by price: ranges are halved until each fits a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.sources.scratch import kept

#: Bits of a price in cents, bits of the item's own digest below them, and bits that a round looks at.
PRICE_BITS, KEY_BITS, ROUND_BITS = 40, 64, 20


def place_bits(price: Column, key: Column) -> Column:
    """The cents of a price as 40 bits, then 64 bits of the key's MD5: order by price, then spread. Null, negative and huge prices count as 0 and the greatest."""
    cents = F.greatest(F.lit(0), F.least(F.lit((1 << PRICE_BITS) - 1), F.round(F.coalesce(price.cast("double"), F.lit(0.0)) * 100).cast("long")))
    digest = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 16), 16, 2)
    return F.concat(F.lpad(F.conv(cents.cast("string"), 10, 2), PRICE_BITS, "0"), F.lpad(digest, KEY_BITS, "0"))


def price_pages(items: DataFrame, price: str, key: str, size: int = 500) -> DataFrame:
    """``items`` with ``page`` (bits of its range) and ``page_items``: every item in exactly one page of at most ``size``.

    A range is split in two halves while it holds more; the sums of all halves of
    a round come from one aggregation. Prices below a cent apart, and one price
    that many items share, are split on by the items' digests; only items of one
    key can make a page larger. Columns ``page``, ``page_items`` and ``bits_``
    are replaced.
    """
    rows = kept(items.drop("page", "page_items").withColumn("bits_", place_bits(F.col(price), F.col(key))), "priced")
    done, base = None, 0
    open_ = rows.sparkSession.createDataFrame([("",)], "parent string")
    while base < PRICE_BITS + KEY_BITS:
        top = min(base + ROUND_BITS, PRICE_BITS + KEY_BITS)
        own = rows.select(F.substring("bits_", 1, base).alias("parent") if base else F.lit("").alias("parent"), F.substring("bits_", 1, top).alias("leaf")).join(open_, "parent", "left_semi")
        leaves = own.groupBy("leaf").agg(F.count("*").alias("n"))
        halves = leaves.select("n", F.explode(F.transform(F.sequence(F.lit(base), F.lit(top)), lambda d: F.struct(d.alias("depth"), F.substring(F.col("leaf"), F.lit(1), d).alias("page")))).alias("h")).select("h.*", "n")
        sums = kept(halves.groupBy("depth", "page").agg(F.sum("n").alias("page_items")), "halves")
        last = (F.col("depth") == PRICE_BITS + KEY_BITS)
        fits = (F.col("page_items") <= size) | last
        split = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("page").alias("up"))
        found = sums.where(f"depth > {base}").withColumn("up", F.expr("substring(page, 1, depth - 1)")).join(split, ["depth", "up"], "left_semi").where(fits).select("page", "page_items")
        if base == 0:
            found = found.unionByName(sums.where("depth = 0").where(fits).select("page", "page_items"))
        done = found if done is None else done.unionByName(found)
        open_ = kept(sums.where((F.col("depth") == top) & ~fits).select(F.col("page").alias("parent")), "open")
        base = top
        if open_.isEmpty():
            break
    done = kept(done, "pages")
    depths = [r[0] for r in done.select(F.length("page")).distinct().collect()]  # at most as many as there are bits
    where = F.explode(F.array(*(F.substring("bits_", 1, d) if d else F.lit("") for d in sorted(depths)))) if depths else F.lit("")
    return rows.withColumn("page", where).join(done, "page").drop("bits_")
