"""Queries over products, sites, listings, snapshots, matches and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.operators import health, listings as L, ranking as R, text_search as T, trees, upserts
from tallymart.plans.registry import query
from tallymart.sources.adapters import AS_OF, INDEXED, Domain


def num(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# Rankings -------------------------------------------------------------------

_LATEST = "SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY listing_id ORDER BY captured_at DESC, order_id DESC, line_no DESC, tie DESC) AS rn FROM price_snapshots s) WHERE rn = 1"
_RANK = "CASE status WHEN 'confirmed' THEN 0 WHEN 'auto_matched' THEN 1 WHEN 'needs_review' THEN 2 WHEN 'low_confidence' THEN 3 ELSE 4 END"
_BEST = f"SELECT listing_id, product_id, status, match_score FROM (SELECT m.*, row_number() OVER (PARTITION BY listing_id ORDER BY {_RANK}, match_score DESC, product_id) AS rn FROM matches m WHERE status <> 'rejected') WHERE rn = 1"
_BEST_ALL = _BEST.replace(" WHERE status <> 'rejected'", "")
_LINKS = "SELECT product_id, id AS listing_id FROM listings WHERE product_id IS NOT NULL UNION SELECT product_id, listing_id FROM matches WHERE status IN ('confirmed', 'auto_matched')"


@query("win_latest_price", f"SELECT listing_id, price::DOUBLE AS price, captured_at FROM ({_LATEST})")
def win_latest_price(d: Domain) -> DataFrame:
    return d.latest_prices.select("listing_id", num("price").alias("price"), "captured_at")


@query("win_best_match", f"SELECT listing_id, product_id, status, match_score::DOUBLE AS match_score FROM ({_BEST})")
def win_best_match(d: Domain) -> DataFrame:
    return R.best_match(d.matches).select("listing_id", "product_id", "status", num("match_score").alias("match_score"))


@query("win_best_match_site", f"SELECT b.listing_id, b.product_id, b.status FROM ({_BEST}) b JOIN listings l ON l.id = b.listing_id WHERE l.competitor_id = 3 AND l.product_id IS NULL")
def win_best_match_site(d: Domain) -> DataFrame:
    scope = d.listings.where("competitor_id = 3 AND product_id IS NULL").select(F.col("id").alias("listing_id"))
    return R.best_match(d.matches, scope=scope).select("listing_id", "product_id", "status")


@query("win_best_match_legacy", "SELECT listing_id, product_id, status FROM (SELECT m.*, row_number() OVER (PARTITION BY listing_id ORDER BY CASE status WHEN 'confirmed' THEN 0 WHEN 'auto_matched' THEN 1 WHEN 'needs_review' THEN 2 ELSE 3 END, match_score DESC, product_id) AS rn FROM matches m) WHERE rn = 1")
def win_best_match_legacy(d: Domain) -> DataFrame:
    return R.best_match_legacy(d.matches).select("listing_id", "product_id", "status")


@query("win_failure_streak", """
SELECT listing_id, max(n)::BIGINT AS longest FROM (SELECT listing_id, a - b AS run, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY captured_at, event_id) AS a, row_number() OVER (PARTITION BY listing_id, outcome ORDER BY captured_at, event_id) AS b FROM outcomes)
  WHERE outcome = 'failed' GROUP BY listing_id, a - b) GROUP BY listing_id""")
def win_failure_streak(d: Domain) -> DataFrame:
    return health.streaks(d.outcomes)


@query("win_topk_snapshots", "SELECT listing_id, rn::INT AS rank, price::DOUBLE AS price FROM (SELECT s.*, row_number() OVER (PARTITION BY listing_id ORDER BY captured_at DESC, order_id DESC, line_no DESC, tie DESC) AS rn FROM price_snapshots s) WHERE rn <= 3")
def win_topk_snapshots(d: Domain) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("listing_id").orderBy(F.desc("captured_at"), F.desc("order_id"), F.desc("line_no"), F.desc("tie"))
    return d.price_snapshots.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("listing_id", "rank", num("price").alias("price"))


# Projections ----------------------------------------------------------------


@query("prj_effective_price", "SELECT id, coalesce(latest_promo_price, latest_price)::DOUBLE AS price FROM listings")
def prj_effective_price(d: Domain) -> DataFrame:
    return d.listings.select("id", num(L.effective_price()).alias("price"))


@query("prj_currency", "SELECT id, coalesce(nullif(latest_currency, ''), 'BGN') AS currency FROM listings")
def prj_currency(d: Domain) -> DataFrame:
    return d.listings.select("id", L.currency().alias("currency"))


@query("prj_last_checked", "SELECT id, coalesce(latest_scraped_at, last_seen_at) AS checked FROM listings")
def prj_last_checked(d: Domain) -> DataFrame:
    return d.listings.select("id", L.last_checked().alias("checked"))


@query("prj_listing_price", f"SELECT l.id, coalesce(l.latest_promo_price, l.latest_price, s.promo_price, s.price)::DOUBLE AS price, CASE WHEN coalesce(l.latest_promo_price, l.latest_price) IS NULL THEN s.availability ELSE l.latest_availability END AS availability FROM listings l LEFT JOIN ({_LATEST}) s ON s.listing_id = l.id")
def prj_listing_price(d: Domain) -> DataFrame:
    s = d.latest_prices.select("listing_id", "promo_price", F.col("price").alias("snap_price"), "availability")
    own = L.effective_price()
    rows = d.listings.join(s, d.listings["id"] == s["listing_id"], "left")
    return rows.select("id", num(F.coalesce(own, "promo_price", "snap_price")).alias("price"), F.when(own.isNull(), F.col("availability")).otherwise(F.col("latest_availability")).alias("availability"))


@query("prj_snapshot_dto", f"SELECT l.id, CASE WHEN coalesce(l.latest_promo_price, l.latest_price) IS NOT NULL THEN 'listing' WHEN s.listing_id IS NOT NULL THEN 'snapshot' ELSE 'none' END AS source FROM listings l LEFT JOIN ({_LATEST}) s ON s.listing_id = l.id")
def prj_snapshot_dto(d: Domain) -> DataFrame:
    s = d.latest_prices.select("listing_id")
    rows = d.listings.join(s, d.listings["id"] == s["listing_id"], "left")
    return rows.select("id", F.when(L.effective_price().isNotNull(), "listing").when(F.col("listing_id").isNotNull(), "snapshot").otherwise("none").alias("source"))


@query("prj_is_scraped", "SELECT id, (latest_scraped_at IS NOT NULL OR latest_price IS NOT NULL OR latest_promo_price IS NOT NULL OR latest_old_price IS NOT NULL) AS scraped FROM listings")
def prj_is_scraped(d: Domain) -> DataFrame:
    return d.listings.select("id", L.is_scraped().alias("scraped"))


def _with_best(d: Domain, rejected: bool = True, listings: DataFrame | None = None) -> DataFrame:
    """Listings (all, or the given ones) with their best match; only matches of the given ones are ranked."""
    rows = d.listings if listings is None else listings
    scope = None if listings is None else listings.select(F.col("id").alias("listing_id"))
    best = R.best_match(d.matches, rejected, scope).select("listing_id", F.col("product_id").alias("best_id"), "status", "match_score")
    return rows.join(best, rows["id"] == best["listing_id"], "left")


@query("prj_effective_status", f"SELECT l.id, CASE WHEN l.product_id IS NOT NULL THEN 'confirmed' ELSE coalesce(b.status, 'no_candidate') END AS status FROM listings l LEFT JOIN ({_BEST_ALL}) b ON b.listing_id = l.id")
def prj_effective_status(d: Domain) -> DataFrame:
    return _with_best(d).select("id", L.effective_status(F.col("product_id"), F.col("status")).alias("status"))


@query("prj_row_status", f"SELECT l.id, coalesce(b.status, CASE WHEN l.product_id IS NOT NULL THEN 'confirmed' END, 'no_candidate') AS status FROM listings l LEFT JOIN ({_BEST_ALL}) b ON b.listing_id = l.id")
def prj_row_status(d: Domain) -> DataFrame:
    return _with_best(d).select("id", L.row_status(F.col("product_id"), F.col("status")).alias("status"))


_ROLES = f"FROM listings l LEFT JOIN ({_BEST_ALL}) b ON b.listing_id = l.id LEFT JOIN products p ON p.id = l.product_id LEFT JOIN products q ON q.id = b.product_id"


def _roles(d: Domain, rejected: bool = True, listings: DataFrame | None = None) -> DataFrame:
    p = d.products.select(F.col("id").alias("p_id"), F.col("sku").alias("p_sku"), F.col("name").alias("p_name"), F.col("own_price").alias("p_price"))
    q = d.products.select(F.col("id").alias("q_id"), F.col("sku").alias("q_sku"), F.col("name").alias("q_name"), F.col("own_price").alias("q_price"))
    rows = _with_best(d, rejected, listings)
    return rows.join(p, rows["product_id"] == p["p_id"], "left").join(q, rows["best_id"] == q["q_id"], "left")


_SHOWN = {"sku": "coalesce(nullif(p.sku, ''), q.sku)", "name": "coalesce(nullif(p.name, ''), q.name)", "own": "(CASE WHEN nullif(p.sku, '') IS NOT NULL THEN p.own_price ELSE q.own_price END)::DOUBLE"}


@query("prj_display_match", f"SELECT l.id, {_SHOWN['sku']} AS sku, {_SHOWN['name']} AS name, {_SHOWN['own']} AS own_price {_ROLES}")
def prj_display_match(d: Domain) -> DataFrame:
    return _roles(d).select("id", *_shown())


def _shown() -> list[Column]:
    direct = F.nullif(F.col("p_sku"), F.lit(""))
    return [F.coalesce(direct, "q_sku").alias("sku"), F.coalesce(F.nullif(F.col("p_name"), F.lit("")), "q_name").alias("name"), num(F.when(direct.isNotNull(), F.col("p_price")).otherwise(F.col("q_price"))).alias("own_price")]


@query("jn_left_bestmatch", f"SELECT l.id, b.product_id AS best_id, b.status FROM listings l LEFT JOIN ({_BEST_ALL}) b ON b.listing_id = l.id")
def jn_left_bestmatch(d: Domain) -> DataFrame:
    return _with_best(d).select("id", "best_id", "status")


@query("jn_left_two_roles", f"SELECT l.id, p.sku AS direct_sku, q.sku AS matched_sku {_ROLES}")
def jn_left_two_roles(d: Domain) -> DataFrame:
    return _roles(d).select("id", F.col("p_sku").alias("direct_sku"), F.col("q_sku").alias("matched_sku"))


@query("jn_inner", "SELECT DISTINCT l.competitor_id FROM listings l JOIN matches m ON m.listing_id = l.id WHERE m.status IN ('confirmed', 'auto_matched')")
def jn_inner(d: Domain) -> DataFrame:
    linked = d.matches.where(F.col("status").isin(*R.LINKED)).select("listing_id")
    return d.listings.join(linked, d.listings["id"] == linked["listing_id"]).select("competitor_id").distinct()


@query("jn_eager_parent", "SELECT l.id, c.name AS site, c.country FROM listings l LEFT JOIN competitors c ON c.id = l.competitor_id")
def jn_eager_parent(d: Domain) -> DataFrame:
    c = d.competitors.select(F.col("id").alias("_c"), F.col("name").alias("site"), "country")
    return d.listings.join(c, d.listings["competitor_id"] == c["_c"], "left").select("id", "site", "country")


@query("jn_anti_notin", "SELECT id FROM listings WHERE product_id IS NULL AND id NOT IN (SELECT listing_id FROM matches)")
def jn_anti_notin(d: Domain) -> DataFrame:
    return d.listings.where("product_id IS NULL").join(d.matches.select(F.col("listing_id").alias("id")), "id", "left_anti").select("id")


@query("jn_dict_sku", "SELECT r.row_no, p.id AS product_id FROM import_rows r LEFT JOIN (SELECT sku, min(id) AS id FROM products GROUP BY sku) p ON p.sku = r.sku")
def jn_dict_sku(d: Domain) -> DataFrame:
    first = d.products.groupBy("sku").agg(F.min("id").alias("product_id"))
    return d.import_rows.join(first, "sku", "left").select("row_no", "product_id")


# Filters --------------------------------------------------------------------


@query("flt_matched_products", "SELECT id FROM products p WHERE EXISTS (SELECT 1 FROM matches m WHERE m.product_id = p.id AND m.status IN ('confirmed', 'auto_matched')) OR EXISTS (SELECT 1 FROM listings l WHERE l.product_id = p.id)")
def flt_matched_products(d: Domain) -> DataFrame:
    return L.matched_products(d.products, d.listings, d.matches).select("id")


@query("flt_matched_via_site", "SELECT id FROM products p WHERE EXISTS (SELECT 1 FROM matches m JOIN listings l ON l.id = m.listing_id WHERE m.product_id = p.id AND m.status IN ('confirmed', 'auto_matched') AND l.competitor_id = 3) OR EXISTS (SELECT 1 FROM listings l WHERE l.product_id = p.id AND l.competitor_id = 3)")
def flt_matched_via_site(d: Domain) -> DataFrame:
    site = d.listings.where("competitor_id = 3")
    own = d.matches.join(site.select(F.col("id").alias("listing_id")), "listing_id", "left_semi")
    return L.matched_products(d.products, site, own).select("id")


@query("flt_visible_price", f"SELECT p.id FROM products p WHERE EXISTS (SELECT 1 FROM ({_LINKS}) k JOIN listings l ON l.id = k.listing_id WHERE k.product_id = p.id AND coalesce(l.latest_promo_price, l.latest_price) IS NOT NULL AND (l.latest_availability IS NULL OR l.latest_availability <> 'out_of_stock'))")
def flt_visible_price(d: Domain) -> DataFrame:
    seen = d.listings.where(L.effective_price().isNotNull() & (F.col("latest_availability").isNull() | (F.col("latest_availability") != "out_of_stock"))).select(F.col("id").alias("listing_id"))
    k = L.links(d.listings, d.matches, linked_only=True).join(seen, "listing_id", "left_semi")
    return d.products.join(k.select(F.col("product_id").alias("id")), "id", "left_semi").select("id")


#: Columns that searches look into.
CATALOG_TEXTS = INDEXED["products"]


@query("flt_search_catalog", "SELECT id FROM products WHERE sku ILIKE '%brand#1%' OR name ILIKE '%brand#1%' OR ean ILIKE '%brand#1%' OR brand ILIKE '%brand#1%'")
def flt_search_catalog(d: Domain) -> DataFrame:
    return T.search(d.index("products", CATALOG_TEXTS), "brand#1")


@query("flt_search_workspace", "SELECT id FROM listings l WHERE title ILIKE '%of shop 1%' OR url ILIKE '%of shop 1%' OR sku ILIKE '%of shop 1%' OR product_id IN (SELECT id FROM products WHERE brand ILIKE '%of shop 1%' OR sku ILIKE '%sku-1%') OR id IN (SELECT listing_id FROM matches WHERE status <> 'rejected' AND product_id IN (SELECT id FROM products WHERE brand ILIKE '%of shop 1%' OR sku ILIKE '%sku-1%'))")
def flt_search_workspace(d: Domain) -> DataFrame:
    found = d.search("products", "of shop 1", ("brand",)).unionByName(d.search("products", "sku-1", ("sku",))).select(F.col("id").alias("product_id"))
    ids = d.search("listings", "of shop 1")
    direct = d.listings.join(found, "product_id", "left_semi").select("id")
    matched = d.matches.where("status <> 'rejected'").join(found, "product_id", "left_semi").select(F.col("listing_id").alias("id"))
    return ids.unionByName(direct).unionByName(matched).distinct()


@query("flt_search_export", "SELECT l.id FROM listings l LEFT JOIN products p ON p.id = l.product_id WHERE l.title ILIKE '%shop 2%' OR l.url ILIKE '%shop 2%' OR p.sku ILIKE '%sku-2%' OR p.name ILIKE '%shop 2%'")
def flt_search_export(d: Domain) -> DataFrame:
    products = d.search("products", "shop 2", ("name",)).unionByName(d.search("products", "sku-2", ("sku",))).select(F.col("id").alias("product_id"))
    own = d.search("listings", "shop 2", ("title", "url"))
    return own.unionByName(d.listings.join(products, "product_id", "left_semi").select("id")).distinct()


@query("flt_status_confirmed", "SELECT id FROM listings WHERE product_id IS NOT NULL")
def flt_status_confirmed(d: Domain) -> DataFrame:
    return d.listings.where("product_id IS NOT NULL").select("id")


@query("flt_status_other", f"SELECT l.id FROM listings l WHERE l.product_id IS NULL AND l.id IN (SELECT listing_id FROM ({_BEST_ALL}) WHERE status = 'needs_review')")
def flt_status_other(d: Domain) -> DataFrame:
    open_ = d.listings.where("product_id IS NULL")
    best = R.best_match(d.matches, True, open_.select(F.col("id").alias("listing_id"))).where("status = 'needs_review'").select(F.col("listing_id").alias("id"))
    return open_.join(best, "id", "left_semi").select("id")


@query("flt_has_price", "SELECT id FROM listings WHERE coalesce(latest_promo_price, latest_price) IS NULL")
def flt_has_price(d: Domain) -> DataFrame:
    return d.listings.where(L.effective_price().isNull()).select("id")


@query("flt_category", "SELECT id FROM products WHERE category = 'STANDARD' OR brand = 'Brand#11'")
def flt_category(d: Domain) -> DataFrame:
    return d.products.where("category = 'STANDARD' OR brand = 'Brand#11'").select("id")


@query("flt_matchable", "SELECT id FROM listings WHERE NOT is_dead AND latest_price IS NOT NULL")
def flt_matchable(d: Domain) -> DataFrame:
    return L.matchable(d.listings).select("id")


@query("flt_scrape_missing", "SELECT id FROM listings WHERE latest_scraped_at IS NULL OR latest_price IS NULL")
def flt_scrape_missing(d: Domain) -> DataFrame:
    return L.missing(d.listings).select("id")


@query("flt_scrape_stale", f"SELECT id FROM listings WHERE latest_scraped_at IS NULL OR latest_scraped_at < TIMESTAMP '{AS_OF}' - INTERVAL 720 HOURS")
def flt_scrape_stale(d: Domain) -> DataFrame:
    return L.stale(d.listings, AS_OF, 9999).select("id")


_RECENT = f"NOT (latest_scrape_status = 'failed' AND latest_scrape_error_code IN ('product_not_found', 'price_not_found', 'playwright_timeout') AND latest_scraped_at IS NOT NULL AND latest_scraped_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20000 HOURS)"


@query("flt_recent_failures", f"SELECT id FROM listings WHERE {_RECENT}")
def flt_recent_failures(d: Domain) -> DataFrame:
    return L.without_recent_failures(d.listings, AS_OF, 20000).select("id")


@query("flt_dead", "SELECT count(*) FILTER (WHERE is_dead) AS dead, count(*) FILTER (WHERE NOT is_dead) AS alive FROM listings")
def flt_dead(d: Domain) -> DataFrame:
    return d.listings.agg(F.count_if("is_dead").alias("dead"), F.count_if(~F.col("is_dead")).alias("alive"))


@query("flt_bulk_skip", f"SELECT id FROM listings WHERE category_id = 3 AND (latest_scraped_at IS NULL OR latest_scraped_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS)")
def flt_bulk_skip(d: Domain) -> DataFrame:
    return L.stale(d.listings.where("category_id = 3"), AS_OF, 24).select("id")


# Set operations -------------------------------------------------------------


@query("set_union_sites", f"SELECT DISTINCT l.competitor_id AS id FROM ({_LINKS}) k JOIN listings l ON l.id = k.listing_id")
def set_union_sites(d: Domain) -> DataFrame:
    k = L.links(d.listings, d.matches, linked_only=True).select(F.col("listing_id").alias("id"))
    return d.listings.join(k, "id", "left_semi").select(F.col("competitor_id").alias("id")).distinct()


@query("set_union_links", "SELECT product_id, id AS listing_id FROM listings WHERE product_id IS NOT NULL UNION SELECT product_id, listing_id FROM matches WHERE status <> 'rejected'")
def set_union_links(d: Domain) -> DataFrame:
    return L.links(d.listings, d.matches)


@query("set_union_links_all", "SELECT product_id, id AS listing_id FROM listings WHERE product_id IS NOT NULL UNION SELECT product_id, listing_id FROM matches")
def set_union_links_all(d: Domain) -> DataFrame:
    return L.links(d.listings, d.matches, rejected=True)


# Aggregations ---------------------------------------------------------------

_STATS = """count(*) AS total, count(*) FILTER (WHERE coalesce(latest_promo_price, latest_price) IS NOT NULL) AS with_price,
  count(*) FILTER (WHERE product_id IS NOT NULL) AS linked, count(*) FILTER (WHERE is_dead) AS dead,
  count(*) FILTER (WHERE latest_availability = 'in_stock') AS in_stock, count(*) FILTER (WHERE latest_scraped_at IS NULL) AS never,
  count(*) FILTER (WHERE latest_scrape_status = 'failed') AS failed, max(coalesce(latest_scraped_at, last_seen_at)) AS checked, max(created_at) AS discovered"""


def _stats() -> list[Column]:
    return [
        F.count("*").alias("total"), F.count(L.effective_price()).alias("with_price"), F.count("product_id").alias("linked"), F.count_if("is_dead").alias("dead"),
        F.count_if(F.col("latest_availability") == "in_stock").alias("in_stock"), F.count_if(F.col("latest_scraped_at").isNull()).alias("never"),
        F.count_if(F.col("latest_scrape_status") == "failed").alias("failed"), F.max(L.last_checked()).alias("checked"), F.max("created_at").alias("discovered"),
    ]


@query("agg_site_stats", f"SELECT competitor_id, {_STATS} FROM listings GROUP BY competitor_id")
def agg_site_stats(d: Domain) -> DataFrame:
    return d.listings.groupBy("competitor_id").agg(*_stats())


@query("agg_coverage_pct", "SELECT competitor_id, round(100.0 * count(coalesce(latest_promo_price, latest_price)) / count(*), 1)::DOUBLE AS pct FROM listings GROUP BY competitor_id")
def agg_coverage_pct(d: Domain) -> DataFrame:
    return d.listings.groupBy("competitor_id").agg(F.round(100.0 * F.count(L.effective_price()) / F.count("*"), 1).alias("pct"))


@query("agg_match_counts", f"SELECT l.competitor_id, b.status, count(*) AS n FROM ({_BEST}) b JOIN listings l ON l.id = b.listing_id WHERE l.product_id IS NULL GROUP BY ALL")
def agg_match_counts(d: Domain) -> DataFrame:
    scope = d.listings.where("product_id IS NULL").select(F.col("id").alias("listing_id"), "competitor_id")
    return R.best_match(d.matches, scope=scope.select("listing_id")).join(scope, "listing_id").groupBy("competitor_id", "status").agg(F.count("*").alias("n"))


@query("agg_sources", "SELECT coalesce(discovery_source, 'manual') AS source, count(*) AS n FROM listings GROUP BY 1")
def agg_sources(d: Domain) -> DataFrame:
    return d.listings.groupBy(F.coalesce("discovery_source", F.lit("manual")).alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("agg_count", "SELECT count(*) AS n FROM products")
def agg_count(d: Domain) -> DataFrame:
    return d.products.agg(F.count("*").alias("n"))


@query("agg_count_subquery", f"SELECT count(*) AS n FROM listings l LEFT JOIN ({_BEST_ALL}) b ON b.listing_id = l.id WHERE b.status = 'rejected'")
def agg_count_subquery(d: Domain) -> DataFrame:
    return _with_best(d).where("status = 'rejected'").agg(F.count("*").alias("n"))


@query("agg_import_counts", "SELECT b.id AS batch_id, count(p.id) AS n FROM import_batches b LEFT JOIN products p ON p.import_batch_id = b.id GROUP BY b.id")
def agg_import_counts(d: Domain) -> DataFrame:
    batches = d.import_batches.select(F.col("id").alias("batch_id"))
    n = d.products.groupBy(F.col("import_batch_id").alias("batch_id")).agg(F.count("*").alias("n"))
    return batches.join(n, "batch_id", "left").select("batch_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_category_counts", "SELECT c.id, count(l.id) AS product_count FROM categories c LEFT JOIN listings l ON l.category_id = c.id GROUP BY c.id")
def agg_category_counts(d: Domain) -> DataFrame:
    return trees.counts(d.categories, d.listings).select("id", "product_count")


@query("agg_country_groups", "SELECT country, count(*) AS n, min(name) AS first_name FROM competitors WHERE is_active GROUP BY country")
def agg_country_groups(d: Domain) -> DataFrame:
    return d.competitors.where("is_active").groupBy("country").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query("agg_scrape_metrics", "SELECT layer, count(*) AS n, count(*) FILTER (WHERE outcome = 'scraped') AS ok, round(100.0 * count(*) FILTER (WHERE outcome = 'scraped') / count(*), 1)::DOUBLE AS ok_pct, count(*) FILTER (WHERE error_code = 'playwright_timeout') AS timeouts, round(avg(price::DOUBLE), 4) AS mean FROM outcomes GROUP BY layer")
def agg_scrape_metrics(d: Domain) -> DataFrame:
    ok = F.count_if(F.col("outcome") == "scraped")
    return d.outcomes.groupBy("layer").agg(F.count("*").alias("n"), ok.alias("ok"), F.round(100.0 * ok / F.count("*"), 1).alias("ok_pct"), F.count_if(F.col("error_code") == "playwright_timeout").alias("timeouts"), F.round(F.avg(num("price")), 4).alias("mean"))


@query("agg_match_outcomes", "SELECT status, match_method, count(*) AS n FROM matches GROUP BY ALL")
def agg_match_outcomes(d: Domain) -> DataFrame:
    return d.matches.groupBy("status", "match_method").agg(F.count("*").alias("n"))


@query("agg_traffic", "SELECT listing_id, count(*) AS urls, round(sum(price::DOUBLE) / count(*), 3) AS per_url FROM outcomes GROUP BY listing_id")
def agg_traffic(d: Domain) -> DataFrame:
    return d.outcomes.groupBy("listing_id").agg(F.count("*").alias("urls"), F.round(F.sum(num("price")) / F.count("*"), 3).alias("per_url"))


@query("agg_subdomains", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def agg_subdomains(d: Domain) -> DataFrame:
    return d.pages.groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host")


@query("agg_facets", f"SELECT DISTINCT 'category' AS kind, category AS value FROM products WHERE category <> '' AND id IN (SELECT product_id FROM ({_LINKS})) UNION SELECT DISTINCT 'brand', brand FROM products WHERE brand <> '' AND id IN (SELECT product_id FROM ({_LINKS}))")
def agg_facets(d: Domain) -> DataFrame:
    p = L.matched_products(d.products, d.listings, d.matches)
    kinds = p.select(F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")), F.struct(F.lit("brand").alias("kind"), F.col("brand").alias("value")))).alias("x")).select("x.*")
    return kinds.where("value <> ''").distinct()


# Comparison -----------------------------------------------------------------

_LINES = f"SELECT k.product_id, l.id AS listing_id, l.competitor_id, coalesce(l.latest_promo_price, l.latest_price)::DOUBLE AS price, coalesce(l.latest_scraped_at, l.last_seen_at) AS checked, l.latest_availability AS a FROM ({_LINKS}) k JOIN listings l ON l.id = k.listing_id"
_COMPARED = f"""
SELECT p.id, p.own_price::DOUBLE AS own_price, x.lowest, x.checked, coalesce(x.n, 0) AS n_links,
       CASE WHEN p.own_price > 0 AND x.lowest IS NOT NULL THEN round((p.own_price::DOUBLE - x.lowest) / p.own_price::DOUBLE * 100, 4) END AS diff_pct,
       CASE WHEN p.own_price IS NULL THEN 'no_own_price' WHEN x.n IS NULL THEN 'no_competitor_match' WHEN x.lowest IS NULL THEN 'no_recent_price'
            WHEN p.own_price::DOUBLE <= x.lowest THEN 'cheapest' ELSE 'more_expensive' END AS status
FROM products p LEFT JOIN (SELECT product_id, count(*) AS n, max(checked) AS checked, min(price) FILTER (WHERE a IS NULL OR a <> 'out_of_stock') AS lowest FROM ({_LINES}) GROUP BY product_id) x ON x.product_id = p.id"""


def comparison_lines(d: Domain) -> DataFrame:
    """Linked listings of each product with their effective price."""
    k = L.links(d.listings, d.matches, linked_only=True)
    l = d.listings.select(F.col("id").alias("listing_id"), "competitor_id", num(L.effective_price()).alias("price"), L.last_checked().alias("checked"), (F.col("latest_availability").isNull() | (F.col("latest_availability") != "out_of_stock")).alias("visible"))
    return k.join(l, "listing_id")


def compared(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Lowest visible price, difference and status of each product."""
    x = lines.groupBy("product_id").agg(F.count("*").alias("n"), F.max("checked").alias("checked"), F.min(F.when(F.col("visible"), F.col("price"))).alias("lowest"))
    own = num("own_price")
    rows = products.join(x, products["id"] == x["product_id"], "left")
    status = F.when(own.isNull(), "no_own_price").when(F.col("n").isNull(), "no_competitor_match").when(F.col("lowest").isNull(), "no_recent_price").when(own <= F.col("lowest"), "cheapest").otherwise("more_expensive")
    return rows.select("id", own.alias("own_price"), "lowest", "checked", F.coalesce("n", F.lit(0)).alias("n_links"), F.round(F.when((own > 0) & F.col("lowest").isNotNull(), (own - F.col("lowest")) / own * 100), 4).alias("diff_pct"), status.alias("status"))


@query("q_price_comparison", _COMPARED)
def q_price_comparison(d: Domain) -> DataFrame:
    return compared(d.products, comparison_lines(d))


@query("q_price_comparison_page", f"WITH page AS (SELECT * FROM products WHERE id IN (SELECT product_id FROM ({_LINKS})) ORDER BY name, id LIMIT 75 OFFSET 25) {_COMPARED.strip().replace('FROM products p', 'FROM page p')}")
def q_price_comparison_page(d: Domain) -> DataFrame:
    page = L.matched_products(d.products, d.listings, d.matches).orderBy("name", "id").offset(25).limit(75)
    lines = comparison_lines(d).join(page.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    return compared(page, lines)


@query("agg_status", f"SELECT status, count(*) AS n FROM ({_COMPARED}) GROUP BY status")
def agg_status(d: Domain) -> DataFrame:
    return q_price_comparison(d).groupBy("status").agg(F.count("*").alias("n"))


@query("agg_min_price", f"SELECT product_id, min(price) AS lowest FROM ({_LINES}) GROUP BY product_id")
def agg_min_price(d: Domain) -> DataFrame:
    return comparison_lines(d).groupBy("product_id").agg(F.min("price").alias("lowest"))


@query("agg_max_checked", f"SELECT product_id, max(checked) AS checked FROM ({_LINES}) GROUP BY product_id")
def agg_max_checked(d: Domain) -> DataFrame:
    return comparison_lines(d).groupBy("product_id").agg(F.max("checked").alias("checked"))


@query("agg_diff_pct", f"SELECT id, diff_pct FROM ({_COMPARED}) WHERE diff_pct IS NOT NULL")
def agg_diff_pct(d: Domain) -> DataFrame:
    return q_price_comparison(d).where("diff_pct IS NOT NULL").select("id", "diff_pct")


@query("agg_lines", f"SELECT product_id, string_agg(listing_id::VARCHAR || '=' || coalesce(round(price, 2)::DECIMAL(14,2)::VARCHAR, ''), ';' ORDER BY listing_id) AS lines FROM ({_LINES}) GROUP BY product_id")
def agg_lines(d: Domain) -> DataFrame:
    one = F.struct("listing_id", F.concat(F.col("listing_id").cast("string"), F.lit("="), F.coalesce(F.round("price", 2).cast("decimal(14,2)").cast("string"), F.lit(""))).alias("t"))
    return comparison_lines(d).groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), ";").alias("lines"))


@query("agg_matrix", f"SELECT product_id, min(price) FILTER (WHERE competitor_id = 1) AS site_1, min(price) FILTER (WHERE competitor_id = 2) AS site_2, min(price) FILTER (WHERE competitor_id = 3) AS site_3 FROM ({_LINES}) GROUP BY product_id")
def agg_matrix(d: Domain) -> DataFrame:
    out = comparison_lines(d).groupBy("product_id").pivot("competitor_id", [1, 2, 3]).agg(F.min("price"))
    return out.select("product_id", *(F.col(str(k)).alias(f"site_{k}") for k in (1, 2, 3)))


@query("q_price_matrix", f"SELECT product_id, competitor_id, min(price) AS price FROM ({_LINES}) WHERE price IS NOT NULL GROUP BY ALL")
def q_price_matrix(d: Domain) -> DataFrame:
    return comparison_lines(d).where("price IS NOT NULL").groupBy("product_id", "competitor_id").agg(F.min("price").alias("price"))


@query("agg_argmin", f"SELECT product_id, listing_id, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, listing_id) AS rn FROM ({_LINES}) WHERE price IS NOT NULL) WHERE rn = 1")
def agg_argmin(d: Domain) -> DataFrame:
    x = comparison_lines(d).where("price IS NOT NULL").groupBy("product_id").agg(F.min(F.struct("price", "listing_id")).alias("m"))
    return x.select("product_id", "m.listing_id", "m.price")


_SUMMARY = f"SELECT (SELECT count(*) FROM products) AS products, (SELECT count(DISTINCT product_id) FROM ({_LINKS}) k JOIN products p ON p.id = k.product_id) AS matched, (SELECT count(*) FROM listings) AS listings, (SELECT count(*) FROM competitors) AS sites, (SELECT count(*) FROM listings WHERE coalesce(latest_promo_price, latest_price) IS NOT NULL) AS priced"


def _summary(d: Domain) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  one row each, so the product is one row
    out = one(d.products, "products")
    for df, name in ((L.matched_products(d.products, d.listings, d.matches), "matched"), (d.listings, "listings"), (d.competitors, "sites"), (d.listings.where(L.effective_price().isNotNull()), "priced")):
        out = out.withColumn("_k", F.lit(1)).join(one(df, name).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out


query("agg_summary", _SUMMARY)(_summary)
query("q_summary", _SUMMARY)(_summary)
query("q_facets", f"SELECT DISTINCT category FROM products WHERE category <> '' AND id IN (SELECT product_id FROM ({_LINKS}))")(lambda d: L.matched_products(d.products, d.listings, d.matches).where("category <> ''").select("category").distinct())
query("q_matched_sites", f"SELECT c.id, c.name FROM competitors c WHERE c.id IN (SELECT l.competitor_id FROM ({_LINKS}) k JOIN listings l ON l.id = k.listing_id)")(lambda d: d.competitors.join(set_union_sites(d), "id", "left_semi").select("id", "name"))


@query("q_product_prices", "SELECT k.product_id, l.id AS listing_id, c.name AS site, coalesce(l.latest_promo_price, l.latest_price)::DOUBLE AS price FROM (SELECT product_id, id AS listing_id FROM listings WHERE product_id IS NOT NULL UNION SELECT product_id, listing_id FROM matches) k JOIN listings l ON l.id = k.listing_id LEFT JOIN competitors c ON c.id = l.competitor_id WHERE k.product_id = 7")
def q_product_prices(d: Domain) -> DataFrame:
    k = L.links(d.listings, d.matches, rejected=True).where("product_id = 7")
    l = d.listings.select(F.col("id").alias("listing_id"), "competitor_id", num(L.effective_price()).alias("price"))
    c = d.competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("site"))
    return k.join(l, "listing_id").join(c, "competitor_id", "left").select("product_id", "listing_id", "site", "price")


@query("q_overview", f"SELECT l.id, CASE WHEN l.product_id IS NOT NULL AND b.status IS NULL THEN 'linked' ELSE coalesce(b.status, 'no_candidate') END AS status, coalesce(p.sku, q.sku) AS sku {_ROLES.replace(_BEST_ALL, _BEST)}")
def q_overview(d: Domain) -> DataFrame:
    status = F.when(F.col("product_id").isNotNull() & F.col("status").isNull(), "linked").otherwise(F.coalesce("status", F.lit("no_candidate")))
    return _roles(d, rejected=False).select("id", status.alias("status"), F.coalesce("p_sku", "q_sku").alias("sku"))


_SORT = "ORDER BY latest_scraped_at DESC NULLS LAST, created_at DESC, id LIMIT 75"


@query("q_workspace_site", f"WITH page AS (SELECT * FROM listings WHERE competitor_id = 3 {_SORT}) SELECT l.id, {_SHOWN['sku']} AS sku, {_SHOWN['name']} AS name, {_SHOWN['own']} AS own_price, coalesce(b.status, CASE WHEN l.product_id IS NOT NULL THEN 'confirmed' END, 'no_candidate') AS status, (SELECT count(*) FROM listings WHERE competitor_id = 3) AS total {_ROLES.replace('FROM listings l', 'FROM page l')}")
def q_workspace_site(d: Domain) -> DataFrame:
    scope = d.listings.where("competitor_id = 3")
    # lean ids first; the wide joins see one page only
    ids = scope.select("id", "latest_scraped_at", "created_at").orderBy(F.desc_nulls_last("latest_scraped_at"), F.desc("created_at"), "id").limit(75).select("id")
    total = scope.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    rows = _roles(d, listings=d.listings.join(ids, "id", "left_semi")).select("id", *_shown(), L.row_status(F.col("product_id"), F.col("status")).alias("status"))
    return rows.withColumn("_k", F.lit(1)).join(total, "_k").drop("_k")


@query("q_workspace_category", f"WITH page AS (SELECT * FROM listings WHERE category_id = 4 AND product_id IS NULL {_SORT}) SELECT id, url FROM page")
def q_workspace_category(d: Domain) -> DataFrame:
    return d.listings.where("category_id = 4 AND product_id IS NULL").orderBy(F.desc_nulls_last("latest_scraped_at"), F.desc("created_at"), "id").limit(75).select("id", "url")


@query("q_export", f"SELECT c.name AS \"Competitor\", l.title AS \"Title\", l.url AS \"URL\", l.ean AS \"EAN\", coalesce(l.latest_promo_price, l.latest_price)::DOUBLE AS \"Final EUR\", l.latest_price::DOUBLE AS \"Regular EUR\", {_SHOWN['sku']} AS \"Matched SKU\", b.match_score::DOUBLE AS \"Score\" {_ROLES} LEFT JOIN competitors c ON c.id = l.competitor_id WHERE l.competitor_id = 3 ORDER BY l.latest_scraped_at DESC NULLS LAST, l.created_at DESC, l.id LIMIT 50000")
def q_export(d: Domain) -> DataFrame:
    rows = _roles(d, listings=d.listings.where("competitor_id = 3"))
    c = d.competitors.select(F.col("id").alias("_c"), F.col("name").alias("Competitor"))
    rows = rows.join(c, rows["competitor_id"] == c["_c"], "left").orderBy(F.desc_nulls_last("latest_scraped_at"), F.desc("created_at"), "id").limit(50_000)
    return rows.select("Competitor", F.col("title").alias("Title"), F.col("url").alias("URL"), F.col("ean").alias("EAN"), num(L.effective_price()).alias("Final EUR"), num("latest_price").alias("Regular EUR"), _shown()[0].alias("Matched SKU"), num("match_score").alias("Score"))


@query("q_site_stats", f"SELECT s.*, round(100.0 * s.with_price / s.total, 1)::DOUBLE AS coverage, coalesce(m.n, 0) AS confirmed FROM (SELECT competitor_id, {_STATS} FROM listings GROUP BY competitor_id) s LEFT JOIN (SELECT l.competitor_id, count(*) AS n FROM ({_BEST}) b JOIN listings l ON l.id = b.listing_id WHERE l.product_id IS NULL AND b.status = 'confirmed' GROUP BY 1) m ON m.competitor_id = s.competitor_id")
def q_site_stats(d: Domain) -> DataFrame:
    n = agg_match_counts(d).where("status = 'confirmed'").select("competitor_id", "n")
    return agg_site_stats(d).join(n, "competitor_id", "left").withColumn("coverage", F.round(100.0 * F.col("with_price") / F.col("total"), 1)).withColumn("confirmed", F.coalesce("n", F.lit(0))).drop("n")


_DASH = f"SELECT k.product_id, min(coalesce(s.promo_price, s.price))::DOUBLE AS lowest, count(*) AS n FROM (SELECT product_id, id AS listing_id FROM listings WHERE product_id IS NOT NULL UNION SELECT product_id, listing_id FROM matches) k JOIN ({_LATEST}) s ON s.listing_id = k.listing_id GROUP BY k.product_id"


def _dashboard(d: Domain) -> DataFrame:
    s = d.latest_prices.select("listing_id", num(F.coalesce("promo_price", "price")).alias("price"))
    return L.links(d.listings, d.matches, rejected=True, dealt="listing_id").join(s, "listing_id").groupBy("product_id").agg(F.min("price").alias("lowest"), F.count("*").alias("n"))


query("agg_dashboard", _DASH)(_dashboard)
query("q_dashboard", _DASH)(_dashboard)
query("q_imports", "SELECT b.id AS batch_id, b.filename, b.created_at, count(p.id) AS n FROM import_batches b LEFT JOIN products p ON p.import_batch_id = b.id GROUP BY ALL ORDER BY b.created_at DESC, b.id")(lambda d: d.import_batches.withColumnRenamed("id", "batch_id").join(agg_import_counts(d), "batch_id").orderBy(F.desc("created_at"), "batch_id"))
query("q_import_products", "SELECT id, sku FROM products WHERE import_batch_id = 5 ORDER BY id LIMIT 200")(lambda d: d.products.where("import_batch_id = 5").orderBy("id").limit(200).select("id", "sku"))
query("q_products_page", "SELECT id, sku FROM products ORDER BY id DESC LIMIT 75 OFFSET 75")(lambda d: d.products.orderBy(F.desc("id")).offset(75).limit(75).select("id", "sku"))
query("q_listings_page", "SELECT id FROM listings ORDER BY created_at DESC, id LIMIT 75")(lambda d: d.listings.orderBy(F.desc("created_at"), "id").limit(75).select("id"))
query("q_snapshots", "SELECT listing_id, captured_at FROM price_snapshots ORDER BY captured_at DESC, order_id DESC, line_no DESC, tie DESC LIMIT 100")(lambda d: d.price_snapshots.orderBy(F.desc("captured_at"), F.desc("order_id"), F.desc("line_no"), F.desc("tie")).limit(100).select("listing_id", "captured_at"))
query("q_scrape_targets", f"SELECT id FROM listings WHERE NOT is_dead AND (latest_scraped_at IS NULL OR latest_price IS NULL) AND {_RECENT}")(lambda d: L.without_recent_failures(L.missing(d.listings.where(~F.col("is_dead"))), AS_OF, 20000).select("id"))
query("q_category_targets", "SELECT id FROM listings WHERE category_id = 7")(lambda d: d.listings.where("category_id = 7").select("id"))
query("src_table", "SELECT id, name FROM competitors WHERE is_active")(lambda d: d.competitors.where("is_active").select("id", "name"))
query("src_point", "SELECT id, sku FROM products WHERE id = 42")(lambda d: d.products.where("id = 42").select("id", "sku"))
query("srt_nulls_last", f"SELECT id FROM listings {_SORT}")(lambda d: d.listings.orderBy(F.desc_nulls_last("latest_scraped_at"), F.desc("created_at"), "id").limit(75).select("id"))
query("lim_offset_page", "SELECT id, (SELECT count(*) FROM products) > 200 AS has_more FROM (SELECT id FROM products ORDER BY name, id LIMIT 100 OFFSET 100)")(lambda d: d.products.orderBy("name", "id").offset(100).limit(100).select("id").withColumn("_k", F.lit(1)).join(d.products.agg((F.count("*") > 200).alias("has_more")).withColumn("_k", F.lit(1)), "_k").drop("_k"))
query("lim_keyset", "SELECT id FROM listings WHERE id > 1000000 ORDER BY id LIMIT 100")(lambda d: d.listings.where("id > 1000000").orderBy("id").limit(100).select("id"))
query("srt_name", "SELECT id FROM products ORDER BY name, id LIMIT 50")(lambda d: d.products.orderBy("name", "id").limit(50).select("id"))


# Trees, health and upserts --------------------------------------------------

_PATHS = "WITH RECURSIVE t(id, parent_id, level, path) AS (SELECT id, parent_id, level, name FROM categories WHERE parent_id IS NULL UNION ALL SELECT c.id, c.parent_id, c.level, t.path || ' > ' || c.name FROM categories c JOIN t ON c.parent_id = t.id) SELECT id, path FROM t"


@query("tr_path", _PATHS)
def tr_path(d: Domain) -> DataFrame:
    return trees.paths(d.categories).select("id", "path")


query("q_tree", _PATHS.replace("SELECT id, path FROM t", "SELECT id, parent_id, level, path FROM t"))(lambda d: trees.paths(d.categories).select("id", "parent_id", "level", "path"))
query("jn_self_tree", "SELECT c.id, p.name AS parent FROM categories c LEFT JOIN categories p ON p.id = c.parent_id")(lambda d: d.categories.alias("c").join(d.categories.alias("p"), F.col("c.parent_id") == F.col("p.id"), "left").select("c.id", F.col("p.name").alias("parent")))
query("tr_forest", "SELECT parent_id, string_agg(name, ',' ORDER BY level, lower(name)) AS children FROM (SELECT coalesce(parent_id, -1) AS parent_id, name, level FROM categories) GROUP BY parent_id")(lambda d: d.categories.groupBy(F.coalesce("parent_id", F.lit(-1)).alias("parent_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", F.lower("name").alias("l"), "name"))), lambda x: x["name"]), ",").alias("children")))
query("tr_export_path", _PATHS.replace("SELECT id, path FROM t", "SELECT l.id, coalesce(t.path, '') AS path FROM listings l LEFT JOIN t ON t.id = l.category_id + 100"))(lambda d: d.listings.join(trees.paths(d.categories).select((F.col("id") - 100).alias("category_id"), "path"), "category_id", "left").select("id", F.coalesce("path", F.lit("")).alias("path")))


@query("st_url_health", """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY captured_at, event_id) AS k FROM outcomes),
f(listing_id, k, t, n, d) AS (SELECT DISTINCT listing_id, 0::BIGINT, 0, 0, false FROM outcomes UNION ALL
 SELECT o.listing_id, o.k,
  CASE WHEN outcome = 'scraped' THEN 0 WHEN error_code = 'playwright_timeout' THEN t + 1 WHEN error_code IN ('product_not_found', 'price_not_found') THEN 0 ELSE t END,
  CASE WHEN outcome = 'scraped' OR error_code = 'playwright_timeout' THEN 0 WHEN error_code = 'product_not_found' THEN n + 1 ELSE n END,
  d OR (outcome <> 'scraped' AND ((error_code = 'playwright_timeout' AND t >= 2) OR (error_code = 'product_not_found' AND n >= 1)))
 FROM f JOIN o ON o.listing_id = f.listing_id AND o.k = f.k + 1)
SELECT listing_id, t AS timeouts, n AS not_found, d AS is_dead FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY k DESC) AS rn FROM f) WHERE rn = 1""")
def st_url_health(d: Domain) -> DataFrame:
    return health.fold(d.outcomes)


@query("st_concurrency", "SELECT event_id, round(avg(CASE WHEN error_code = 'playwright_timeout' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY listing_id ORDER BY captured_at, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 4)::DOUBLE AS rate FROM outcomes")
def st_concurrency(d: Domain) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("listing_id").orderBy("captured_at", "event_id").rowsBetween(-99, 0)
    late = F.when(F.col("error_code") == "playwright_timeout", 1.0).otherwise(0.0)
    return d.outcomes.select("event_id", F.round(F.avg(late).over(w), 4).alias("rate"))


@query("st_apply_observation", """
SELECT l.id, coalesce(p.price, l.latest_price)::DOUBLE AS latest_price, CASE WHEN o.event_id IS NULL THEN l.latest_scrape_status WHEN o.outcome = 'scraped' THEN 'success' ELSE 'failed' END AS latest_scrape_status
FROM listings l
LEFT JOIN (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY listing_id ORDER BY captured_at DESC, event_id DESC) AS rn FROM outcomes o) WHERE rn = 1) o ON o.listing_id = l.part_id
LEFT JOIN (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY listing_id ORDER BY captured_at DESC, event_id DESC) AS rn FROM outcomes o WHERE outcome = 'scraped' AND price IS NOT NULL) WHERE rn = 1) p ON p.listing_id = l.part_id""")
def st_apply_observation(d: Domain) -> DataFrame:
    return upserts.applied_observations(d.listings, d.outcomes, on="part_id").select("id", num("latest_price").alias("latest_price"), "latest_scrape_status")


_CLEAN = "CASE WHEN lower(trim({0})) IN ('', '-', '--', '—', '–', '.', 'n/a', 'na', 'none', 'null', 'x') THEN NULL ELSE trim({0}) END"
_CHECKED = f"SELECT row_no, batch_id, ean, manufacturer_code, name, coalesce(sku, ean) AS sku, CASE WHEN op = '12,50' THEN 12.5 WHEN op = '99.9' THEN 99.9 END AS price, CASE WHEN ean IS NULL THEN 'missing ean' WHEN manufacturer_code IS NULL THEN 'missing manufacturer_code' WHEN name IS NULL THEN 'missing name' WHEN op IS NULL THEN 'missing own_price' WHEN op = 'abc' THEN 'bad own_price' END AS error FROM (SELECT row_no, batch_id, {_CLEAN.format('ean')} AS ean, {_CLEAN.format('manufacturer_code')} AS manufacturer_code, {_CLEAN.format('name')} AS name, {_CLEAN.format('own_price')} AS op, {_CLEAN.format('sku')} AS sku FROM import_rows)"


@query("up_import", f"SELECT coalesce(o.sku, g.sku) AS sku, coalesce(g.name, o.name) AS name, CASE WHEN g.sku IS NULL THEN 'kept' WHEN o.sku IS NULL THEN 'inserted' ELSE 'updated' END AS action, coalesce(g.price::DOUBLE, o.own_price::DOUBLE) AS own_price FROM (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY sku ORDER BY id) AS rn FROM products p) WHERE rn = 1) o FULL JOIN (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY sku ORDER BY row_no DESC) AS rn FROM ({_CHECKED}) c WHERE error IS NULL) WHERE rn = 1) g ON g.sku = o.sku")
def up_import(d: Domain) -> DataFrame:
    return upserts.imported(d.products, d.import_rows).select("sku", "name", "action", num("own_price").alias("own_price"))


query("up_import_counts", f"SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS imported, count(error) AS skipped FROM ({_CHECKED}) GROUP BY batch_id")(lambda d: upserts.checked_rows(d.import_rows).groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("imported"), F.count("error").alias("skipped")))
query("up_delete_batch", "SELECT id FROM products WHERE import_batch_id <> 5")(lambda d: upserts.without_batch(d.import_batches, d.products, 5).select("id"))


def _pairs(d: Domain) -> DataFrame:
    return d.listings.where("part_id % 50 = 0").select(F.col("id").alias("listing_id"), F.col("part_id").alias("product_id"))


_PAIRS = "SELECT id AS listing_id, part_id AS product_id FROM listings WHERE part_id % 50 = 0"


@query("up_confirm", f"SELECT coalesce(m.listing_id, k.listing_id) AS listing_id, coalesce(m.product_id, k.product_id) AS product_id, CASE WHEN k.listing_id IS NOT NULL THEN 'confirmed' ELSE m.status END AS status FROM matches m FULL JOIN ({_PAIRS}) k ON k.listing_id = m.listing_id AND k.product_id = m.product_id")
def up_confirm(d: Domain) -> DataFrame:
    return upserts.confirmed(d.matches, d.listings, _pairs(d))[0].select("listing_id", "product_id", "status")


@query("up_reject", f"SELECT l.id, CASE WHEN l.product_id = k.product_id THEN NULL ELSE l.product_id END AS product_id FROM listings l LEFT JOIN ({_PAIRS}) k ON k.listing_id = l.id")
def up_reject(d: Domain) -> DataFrame:
    return upserts.rejected(d.matches, d.listings, _pairs(d))[1].select("id", "product_id")


@query("up_skip_rule", "SELECT l.id, CASE WHEN m.c THEN 'confirmed' WHEN m.r THEN 'rejected' WHEN m.listing_id IS NOT NULL THEN 'matched' END AS skip FROM listings l LEFT JOIN (SELECT listing_id, bool_or(status = 'confirmed') AS c, bool_or(status = 'rejected') AS r FROM matches GROUP BY 1) m ON m.listing_id = l.id")
def up_skip_rule(d: Domain) -> DataFrame:
    return upserts.to_match(d.listings, d.matches, True)


@query("up_match_persist", "SELECT listing_id, product_id, status FROM matches WHERE listing_id % 2 = 1 OR status IN ('confirmed', 'rejected') UNION ALL SELECT id, part_id, 'auto_matched' FROM listings WHERE id % 2 = 0 AND latest_price IS NOT NULL")
def up_match_persist(d: Domain) -> DataFrame:
    plan = d.listings.where("id % 2 = 0").select(F.col("id").alias("listing_id"), F.col("part_id").alias("product_id"), F.lit("auto_matched").alias("status"), F.col("latest_price").isNotNull().alias("persist"))
    fixed = d.matches.where("status IN ('confirmed', 'rejected')")
    rest = d.matches.where("status NOT IN ('confirmed', 'rejected')").join(plan, "listing_id", "left_anti")
    return fixed.unionByName(rest).select("listing_id", "product_id", "status").unionByName(plan.where("persist").drop("persist"))
