"""Expressions and filters over listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions import markup
from tallymart.operators.ranking import LINKED, first_of

HARD_FAILURES = ("product_not_found", "price_not_found", "playwright_timeout")


def effective_price() -> Column:
    return F.coalesce("latest_promo_price", "latest_price")


def currency() -> Column:
    return F.coalesce(F.nullif(F.col("latest_currency"), F.lit("")), F.lit("BGN"))


def last_checked() -> Column:
    return F.coalesce("latest_scraped_at", "last_seen_at")


def is_scraped() -> Column:
    return F.col("latest_scraped_at").isNotNull() | F.col("latest_price").isNotNull() | F.col("latest_promo_price").isNotNull() | F.col("latest_old_price").isNotNull()


def effective_status(direct: Column, status: Column) -> Column:
    """A direct link counts as confirmed before the best match is asked."""
    return F.when(direct.isNotNull(), "confirmed").otherwise(F.coalesce(status, F.lit("no_candidate")))


def row_status(direct: Column, status: Column) -> Column:
    """The best match is asked before the direct link."""
    return F.coalesce(status, F.when(direct.isNotNull(), F.lit("confirmed")), F.lit("no_candidate"))


def matchable(listings: DataFrame) -> DataFrame:
    return listings.where(~F.col("is_dead") & F.col("latest_price").isNotNull())


def missing(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("latest_scraped_at").isNull() | F.col("latest_price").isNull())


def stale(listings: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {min(720, max(1, hours))} HOURS")
    return listings.where(F.col("latest_scraped_at").isNull() | (F.col("latest_scraped_at") < cut))


def without_recent_failures(listings: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Not failed hard since the cut; as in SQL, an unknown condition drops the row."""
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    bad = (F.col("latest_scrape_status") == "failed") & F.col("latest_scrape_error_code").isin(*HARD_FAILURES) & F.col("latest_scraped_at").isNotNull() & (F.col("latest_scraped_at") >= cut)
    return listings.where(~bad)


def links(listings: DataFrame, matches: DataFrame, linked_only: bool = False, rejected: bool = False, dealt: str | None = None) -> DataFrame:
    """Distinct (product_id, listing_id): direct links and matches; ``dealt``: the one of them that a join takes next, so that one shuffle serves both."""
    if linked_only:
        matches = matches.where(F.col("status").isin(*LINKED))
    elif not rejected:
        matches = matches.where("status <> 'rejected'")
    direct = listings.where("product_id IS NOT NULL").select("product_id", F.col("id").alias("listing_id"))
    both = direct.unionByName(matches.select("product_id", "listing_id"))
    return (both.repartition(dealt) if dealt else both).distinct()


def matched_products(products: DataFrame, listings: DataFrame, matches: DataFrame) -> DataFrame:
    """Products with a direct link or a linked match."""
    return products.join(links(listings, matches, linked_only=True).select(F.col("product_id").alias("id")), "id", "left_semi")


def scraped(listings: DataFrame, wanted: bool | None) -> DataFrame:
    """All listings, or those that were or weren't scraped."""
    return listings if wanted is None else listings.where(is_scraped() if wanted else ~is_scraped())


def of_status(listings: DataFrame, matches: DataFrame, status: str, best) -> DataFrame:
    """Listings of an effective status; ``best`` ranks the matches of a scope."""
    if status == "confirmed":
        return listings.where("product_id IS NOT NULL")
    free = listings.where("product_id IS NULL")
    if status == "no_candidate":
        return free.join(matches.select(F.col("listing_id").alias("id")), "id", "left_anti")
    found = best(matches, True, free.select(F.col("id").alias("listing_id"))).where(F.col("status") == status)
    return free.join(found.select(F.col("listing_id").alias("id")), "id", "left_semi")


def page(rows: DataFrame, order: list[Column], limit: int | None = 75, offset: int = 0) -> DataFrame:
    """A page of rows in a total order; no limit: all."""
    out = rows.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("latest_scraped_at"), F.desc("created_at"), F.asc("id")]


def sort_key(name: Column) -> Column:
    """The column that a sort name stands for; unknown names sort by the last scrape."""
    return F.when(name == "created_at", "created_at").otherwise("last_scraped_at")


def page_variants(pages: DataFrame) -> DataFrame:
    """Variants of pages (id, url, html), one row (id, the variant's fields) for each page and variant URL: the first in page order."""
    rows = pages.select("id", F.posexplode(markup.embedded_variants(F.col("html"), F.col("url"))).alias("pos", "v"))
    return first_of(rows.select("id", "pos", "v.*"), ["id", "url"], [F.asc("pos")]).drop("pos")
