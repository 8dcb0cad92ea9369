"""Upserts: each builds the new state of a table from the old and the changes, as Parquet has no MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions.codes import cell_code, placeholder
from tallymart.functions.money import parse_decimal
from tallymart.operators.ranking import first_of
from tallymart.sources.scratch import kept

REQUIRED = ("ean", "manufacturer_code", "name", "own_price")


def checked_rows(rows: DataFrame) -> DataFrame:
    """Import rows with cells cleaned and ``error`` (null: good): the first missing required cell, or a price that isn't one."""
    cells = rows.withColumns({c: placeholder(F.col(c)) for c in (*REQUIRED, "sku")})
    price = parse_decimal(F.col("own_price"))
    error = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED), F.when(price.isNull(), F.lit("bad own_price")))
    return cells.withColumn("sku", F.coalesce("sku", "ean")).withColumn("price", price).withColumn("error", error)


def imported(products: DataFrame, rows: DataFrame) -> DataFrame:
    """(sku, name, ean, own_price, action) after an import: good rows, the last of each sku, over existing products."""
    good = first_of(checked_rows(rows).where("error IS NULL"), ["sku"], [F.desc("row_no")])
    old = first_of(products, ["sku"], [F.asc("id")]).select("sku", F.col("name").alias("old_name"), F.col("ean").alias("old_ean"), F.col("own_price").alias("old_price"), F.lit(True).alias("had"))
    new = good.select("sku", "name", "ean", F.col("price").alias("own_price"), F.lit(True).alias("got"))
    both = old.join(new, "sku", "full_outer")
    action = F.when(F.col("got").isNull(), "kept").when(F.col("had").isNull(), "inserted").otherwise("updated")
    return both.select("sku", F.coalesce("name", "old_name").alias("name"), F.coalesce("ean", "old_ean").alias("ean"), F.coalesce("own_price", "old_price").alias("own_price"), action.alias("action"))


#: Fields of a product that an import sets.
FIELDS = ("name", "ean", "brand", "category", "manufacturer_code", "model", "own_price", "product_url", "image_url", "description", "variant", "color", "size", "storage", "memory", "supplier_sku")


def product_rows(rows: DataFrame) -> DataFrame:
    """Rows of a sheet with ``sku``, the fields cleaned, the price as a number, and ``error``: what a row lacks or has wrong, null if it is good.

    The SKU falls back on the supplier's and then on the EAN. An error of the
    reader stays; a row with an error is given with what it has.
    """
    texts = [c for c in FIELDS if c != "own_price"]
    codes = ("ean", "manufacturer_code", "supplier_sku", "model")
    clean = rows.withColumns({c: cell_code(F.col(c)) if c in codes else placeholder(F.col(c)) for c in texts})
    lacks = [F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in ("ean", "manufacturer_code", "name")]
    price = parse_decimal(placeholder(F.col("own_price")))
    blank = F.trim(F.coalesce("own_price", F.lit(""))) == ""
    wrong = F.when(price.isNull(), F.when(blank, "own_price is required").otherwise(F.concat(F.lit("Invalid own_price: "), F.col("own_price"))))
    error = F.coalesce(F.col("error"), F.nullif(F.concat_ws("; ", *lacks), F.lit("")), wrong)
    sku = F.coalesce(placeholder(F.col("sku")), F.col("supplier_sku"), F.col("ean"))
    return clean.select("file", "row_no", error.alias("error"), sku.alias("sku"), *texts, price.alias("own_price"))


def confirmed(matches: DataFrame, listings: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches and listings after the (listing_id, product_id) pairs were confirmed."""
    hit = pairs.select("listing_id", "product_id", F.lit(True).alias("hit"))
    new = matches.join(hit, ["listing_id", "product_id"], "full_outer")
    new = new.select("listing_id", "product_id", F.when(F.col("hit"), "confirmed").otherwise(F.col("status")).alias("status"), F.coalesce("match_score", F.lit(100).cast("decimal(8,5)")).alias("match_score"), F.coalesce("match_method", F.lit("manual")).alias("match_method"))
    linked = listings.join(pairs.select(F.col("listing_id").alias("id"), F.col("product_id").alias("_p")), "id", "left")
    return new, linked.withColumn("product_id", F.coalesce("_p", "product_id")).drop("_p")


def rejected(matches: DataFrame, listings: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches and listings after the pairs were rejected; a direct link goes if it is to the same product."""
    hit = pairs.select("listing_id", "product_id", F.lit(True).alias("hit"))
    new = matches.join(hit, ["listing_id", "product_id"], "full_outer")
    new = new.select("listing_id", "product_id", F.when(F.col("hit"), "rejected").otherwise(F.col("status")).alias("status"), F.coalesce("match_score", F.lit(0).cast("decimal(8,5)")).alias("match_score"), F.coalesce("match_method", F.lit("manual_reject")).alias("match_method"))
    linked = listings.join(pairs.select(F.col("listing_id").alias("id"), F.col("product_id").alias("_p")), "id", "left")
    return new, linked.withColumn("product_id", F.when(F.col("product_id") == F.col("_p"), F.lit(None)).otherwise(F.col("product_id"))).drop("_p")


def without_batch(batches: DataFrame, products: DataFrame, batch_id: int) -> DataFrame:
    """Products after a batch and all its members were deleted."""
    gone = batches.where(F.col("id") == batch_id).select(F.col("id").alias("import_batch_id"))
    return products.join(gone, "import_batch_id", "left_anti")


def to_match(listings: DataFrame, matches: DataFrame, only_unmatched: bool) -> DataFrame:
    """(id, skip): why a listing isn't matched anew; null where it is."""
    seen = matches.groupBy("listing_id").agg(F.bool_or(F.col("status") == "confirmed").alias("c"), F.bool_or(F.col("status") == "rejected").alias("r"))
    rows = listings.join(seen, listings["id"] == seen["listing_id"], "left")
    skip = F.when(F.col("c"), "confirmed").when(F.col("r"), "rejected")
    if only_unmatched:
        skip = skip.when(F.col("c").isNotNull(), "matched")
    return rows.select("id", skip.alias("skip"))


def applied_observations(listings: DataFrame, observed: DataFrame, on: str = "id") -> DataFrame:
    """Listings after observations: the newest sets status and error; the newest success sets the prices it has.

    ``on``: the column of listings that the observations' ``listing_id`` names;
    where many listings share it, observations are reduced before they meet them.
    """
    at = F.struct("captured_at", "event_id")
    priced = F.when((F.col("outcome") == "scraped") & F.col("price").isNotNull(), at)
    last = observed.groupBy("listing_id").agg(F.max_by(F.struct("captured_at", "outcome", "error_code"), at).alias("o"), F.max_by("price", priced).alias("p"))
    own = listings.select("id", F.col(on).alias("observed_as"), "latest_price", "latest_scraped_at", "latest_scrape_status", "latest_scrape_error_code")
    rows = own.join(last, own["observed_as"] == last["listing_id"], "left")
    return rows.select(
        "id",
        F.coalesce("p", "latest_price").alias("latest_price"),
        F.coalesce(F.col("o.captured_at"), F.col("latest_scraped_at")).alias("latest_scraped_at"),
        F.when(F.col("o").isNull(), F.col("latest_scrape_status")).when(F.col("o.outcome") == "scraped", "success").otherwise("failed").alias("latest_scrape_status"),
        F.when(F.col("o").isNull(), F.col("latest_scrape_error_code")).otherwise(F.col("o.error_code")).alias("latest_scrape_error_code"),
    )


def undiscovered(urls: DataFrame, listings: DataFrame, key) -> DataFrame:
    """Distinct new URLs: those whose key no listing has, the first of each key."""
    found = urls.withColumn("key", key(F.col("url"))).where("key IS NOT NULL").groupBy("key").agg(F.min("url").alias("url"))
    return found.join(listings.select(key(F.col("url")).alias("key")).distinct(), "key", "left_anti")


def appended(history: DataFrame, observed: DataFrame, keep: bool = True) -> DataFrame:
    """(listing_id, captured_at, price) after observations were appended, failures too; without ``keep`` as it was."""
    old = history.select("listing_id", "captured_at", "price")
    return old.unionByName(observed.select("listing_id", "captured_at", "price")) if keep else old


def with_variants(listings: DataFrame, variants: DataFrame) -> DataFrame:
    """(competitor_id, url, is_new): listings and those variants whose site and URL none has yet, each once."""
    have = listings.select("competitor_id", "url").distinct()
    new = variants.select("competitor_id", "url").distinct().join(have, ["competitor_id", "url"], "left_anti")
    return have.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))


def requested(listings: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, listing_id, result) of requests (request_id, competitor_id, url): existing, conflict where another site owns the URL, else created."""
    owner = first_of(listings, ["url"], [F.asc("id")]).select("url", F.col("id").alias("listing_id"), F.col("competitor_id").alias("owner"))
    rows = requests.join(owner, "url", "left")
    result = F.when(F.col("owner").isNull(), "created").when(F.col("owner") == F.col("competitor_id"), "existing").otherwise("conflict")
    return rows.select("request_id", F.when(result == "existing", F.col("listing_id")).alias("listing_id"), result.alias("result"))


def below(categories: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of all that hangs below ``roots`` (id) at any depth, the roots only where a cycle leads back to them.

    One join a level, each written; a cycle ends when nothing new is met.
    """
    tree = categories.select("id", F.col("parent_id").alias("up"))
    level = kept(tree.join(roots.select(F.col("id").alias("up")), "up", "left_semi").select("id").distinct(), "tree-level")
    found = level
    while not level.isEmpty():
        met = tree.join(level.select(F.col("id").alias("up")), "up", "left_semi").select("id").distinct()
        level = kept(met.join(found, "id", "left_anti"), "tree-level")
        found = found.unionByName(level)
    return found


def replaced_tree(categories: DataFrame, new: DataFrame, roots: DataFrame) -> DataFrame:
    """Categories (id, parent_id, name, level) after all that hangs below ``roots`` (id) was deleted and ``new`` ones put in."""
    roots = roots.select("id").distinct()
    above = below(categories, roots).unionByName(roots).distinct().select(F.col("id").alias("parent_id"), F.lit(True).alias("gone_"))
    rest = categories.join(above, "parent_id", "left").join(roots.withColumn("root_", F.lit(True)), "id", "left").where("gone_ IS NULL OR root_")
    return rest.select("id", "parent_id", "name", "level").unionByName(new.select("id", "parent_id", "name", "level"))


def categories_for(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """(request_id, category_id, is_new) of requests (request_id, category_id, parent_id, name): the assigned category stays; else one of that name and parent, the least id; else a new one."""
    known = categories.groupBy("parent_id", F.lower("name").alias("_key")).agg(F.min("id").alias("found"))
    rows = requests.withColumn("_key", F.lower("name")).alias("r").join(known.alias("k"), F.expr("r.parent_id <=> k.parent_id AND r._key = k._key"), "left")
    category = F.coalesce(F.col("r.category_id"), F.col("k.found"))
    return rows.select("request_id", category.alias("category_id"), category.isNull().alias("is_new"))
