"""Sitemaps followed to a fixed point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions.markup import sitemap_parts
from tallymart.sources.scratch import kept


def followed(bodies: DataFrame, roots: DataFrame) -> DataFrame:
    """(url, kind): all that is reached from the sitemaps ``roots`` (url): ``sitemap`` for those named, ``page`` for pages.

    ``bodies`` (url, body) has the sitemaps at hand. Each round reads those that
    the last one has named first; a sitemap counts once, so cycles end. Sitemaps
    without a body, broken and null ones name nothing.
    """
    level = kept(roots.where("url IS NOT NULL").select("url").distinct(), "frontier")
    seen, pages = level, None
    while not level.isEmpty():
        parts = kept(bodies.join(level, "url", "left_semi").select(sitemap_parts(F.col("body")).alias("p")), "sitemap-parts")
        found = parts.select(F.explode("p.pages").alias("url")).distinct()
        pages = found if pages is None else pages.unionByName(found)
        level = kept(parts.select(F.explode("p.nested").alias("url")).distinct().join(seen, "url", "left_anti"), "frontier")
        seen = seen.unionByName(level)
    out = seen.withColumn("kind", F.lit("sitemap"))
    return out if pages is None else out.unionByName(pages.distinct().withColumn("kind", F.lit("page")))
