"""Category trees kept as adjacency lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions.urls import path_of
from tallymart.sources.scratch import kept


def paths(categories: DataFrame) -> DataFrame:
    """The categories with ``path``, the names from root to node; a node met again on its way ends the path.

    Every round joins each node's way with that of the node where it ends, so
    a way doubles and the rounds are the logarithm of the depth; each is written,
    so that no plan grows. A parent that doesn't exist ends the path.
    """
    known = categories.select(F.col("id").alias("at"))
    now = categories.select("id", F.col("parent_id").cast("long").alias("at"), F.array("name").alias("names"), F.array(F.col("id").cast("long")).alias("ids"))
    now = kept(now.join(known, "at", "left_semi").select("id", "at", "names", "ids").unionByName(now.join(known, "at", "left_anti").select("id", F.lit(None).cast("long").alias("at"), "names", "ids")), "paths")
    while not now.where("at IS NOT NULL").isEmpty():
        up = now.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("names").alias("_names"), F.col("ids").alias("_ids"))
        both = now.where("at IS NOT NULL").join(up, F.col("at") == F.col("_id"))
        both = both.select("id", F.col("_at").alias("at"), F.concat("names", "_names").alias("names"), F.concat("ids", "_ids").alias("ids"))
        # in a cycle the way ends before the first node that it holds already
        both = both.withColumn("again", F.expr("get(filter(sequence(1, size(ids) - 1), i -> array_position(ids, ids[i]) <= i), 0)"))
        ended = F.col("again").isNotNull()
        both = both.select("id", F.when(~ended, F.col("at")).alias("at"), *(F.when(ended, F.slice(c, 1, F.coalesce("again", F.lit(1)))).otherwise(F.col(c)).alias(c) for c in ("names", "ids")))
        now = kept(now.where("at IS NULL").unionByName(both), "paths")
    return categories.join(now.select("id", F.array_join(F.reverse("names"), " > ").alias("path")), "id")


def counts(categories: DataFrame, listings: DataFrame) -> DataFrame:
    """Categories with their number of listings, 0 where there are none."""
    n = listings.where("category_id IS NOT NULL").groupBy("category_id").agg(F.count("*").alias("product_count"))
    return categories.join(n, categories["id"] == n["category_id"], "left").select(*categories.columns, F.coalesce("product_count", F.lit(0)).cast("long").alias("product_count"))


def parents_of_urls(urls: DataFrame) -> DataFrame:
    """(url, parent, level) for distinct URLs: the parent is the longest other URL path that is a proper prefix."""
    rows = urls.select("url", F.filter(F.split(path_of(F.col("url")), "/"), lambda s: s != "").alias("s")).distinct()
    rows = rows.withColumn("key", F.array_join("s", "/"))
    ups = rows.select("url", F.explode(F.expr("transform(sequence(0, size(s) - 1), k -> array_join(slice(s, 1, k), '/'))")).alias("key")).where("key <> ''")
    known = rows.groupBy("key").agg(F.min("url").alias("parent"))
    best = ups.join(known, "key").groupBy("url").agg(F.max_by("parent", F.length("key")).alias("parent"))
    return rows.join(best, "url", "left").select("url", "parent", F.greatest(F.lit(0), F.least(F.lit(3), F.size("s") - 2)).alias("level"))


def display_path(crumbs: Column, breadcrumb_path: Column, assigned_path: Column) -> Column:
    """The path that is shown: the page's trail, else that of its breadcrumb category, else of the assigned one."""
    return F.coalesce(F.when(F.size(crumbs) > 0, F.array_join(crumbs, " > ")), breadcrumb_path, assigned_path, F.lit("Uncategorized"))
