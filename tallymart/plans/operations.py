"""Queries over pages, batches, sinks, ingest, discovery and category assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymart.functions import codes, fields, markup, urls
from tallymart.operators import health, listings as L, matching as M, ranking as R, trees, upserts
from tallymart.plans.registry import query
from tallymart.plans.relational import _BEST_ALL, _CHECKED, _LATEST, _LINKS, _SHOWN, _ROLES, _SORT, _roles, _shown, num
from tallymart.sources import workbook, xlsx_source
from tallymart.sources.adapters import Domain
from tallymart.sources.keyed_table import KeyedTable, newer_wins
from tallymart.sources.scratch import scratch
from tallymart.streaming import discovery

# Filters and joins -----------------------------------------------------------

query("flt_scraped", "SELECT id FROM listings WHERE NOT (latest_scraped_at IS NOT NULL OR latest_price IS NOT NULL OR latest_promo_price IS NOT NULL OR latest_old_price IS NOT NULL)")(lambda d: L.scraped(d.listings, False).select("id"))
query("flt_status_no_candidate", "SELECT id FROM listings WHERE product_id IS NULL AND id NOT IN (SELECT listing_id FROM matches)")(lambda d: L.of_status(d.listings, d.matches, "no_candidate", R.best_match).select("id"))
query("jn_semi_exists", "SELECT id FROM products p WHERE EXISTS (SELECT 1 FROM matches m WHERE m.product_id = p.id AND m.status IN ('confirmed', 'auto_matched'))")(lambda d: d.products.join(d.matches.where(F.col("status").isin(*R.LINKED)).select(F.col("product_id").alias("id")), "id", "left_semi").select("id"))
query("jn_semi_in", "SELECT id FROM listings WHERE product_id IN (SELECT id FROM products WHERE brand = 'Brand#11')")(lambda d: d.listings.join(d.products.where("brand = 'Brand#11'").select(F.col("id").alias("product_id")), "product_id", "left_semi").select("id"))


@query("jn_app_hash", f"SELECT p.id AS product_id, l.id AS listing_id, c.name AS site FROM (SELECT id FROM products ORDER BY name, id LIMIT 75) p JOIN ({_LINKS}) k ON k.product_id = p.id JOIN listings l ON l.id = k.listing_id LEFT JOIN competitors c ON c.id = l.competitor_id")
def jn_app_hash(d: Domain) -> DataFrame:
    some = L.page(d.products, [F.asc("name"), F.asc("id")]).select(F.col("id").alias("product_id"))
    k = L.links(d.listings, d.matches, linked_only=True).join(some, "product_id", "left_semi")
    c = d.competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("site"))
    rows = k.join(d.listings.select(F.col("id").alias("listing_id"), "competitor_id"), "listing_id").join(c, "competitor_id", "left")
    return rows.select("product_id", "listing_id", "site")


# Sorts and limits ------------------------------------------------------------

query("srt_normalise", "SELECT k, CASE WHEN n3 = 2 THEN 'created_at' ELSE 'last_scraped_at' END AS y FROM cells")(lambda d: d.cells.select("k", L.sort_key(F.expr("CASE n3 WHEN 1 THEN 'last_checked' WHEN 2 THEN 'created_at' WHEN 3 THEN 'last_scraped_at' WHEN 4 THEN NULL ELSE title END")).alias("y")))
query("lim_two_phase", f"WITH page AS (SELECT * FROM listings WHERE competitor_id = 3 {_SORT}) SELECT l.id, {_SHOWN['sku']} AS sku, {_SHOWN['name']} AS name, {_SHOWN['own']} AS own_price {_ROLES.replace('FROM listings l', 'FROM page l')}")(lambda d: _roles(d, listings=d.listings.join(L.page(d.listings.where("competitor_id = 3").select("id", "latest_scraped_at", "created_at"), L.newest_first()).select("id"), "id", "left_semi")).select("id", *_shown()))
query("lim_offset_batch", "SELECT id FROM listings WHERE NOT is_dead AND latest_price IS NOT NULL ORDER BY created_at DESC, id LIMIT 500 OFFSET 500")(lambda d: L.page(L.matchable(d.listings), [F.desc("created_at"), F.asc("id")], 500, 500).select("id"))
query("lim_catalog_batches", "SELECT id FROM products ORDER BY id LIMIT 500 OFFSET 100")(lambda d: L.page(d.products, [F.asc("id")], 500, 100).select("id"))
query("lim_export_cap", f"SELECT id FROM listings {_SORT.replace('75', '1000')}")(lambda d: L.page(d.listings, L.newest_first(), 1000).select("id"))
query("lim_snapshots", "SELECT listing_id, captured_at, price::DOUBLE AS price FROM price_snapshots WHERE listing_id = (SELECT max(listing_id) FROM price_snapshots) ORDER BY captured_at DESC, order_id DESC, line_no DESC, tie DESC LIMIT 100")(lambda d: L.page(d.price_snapshots.join(d.price_snapshots.agg(F.max("listing_id").alias("listing_id")), "listing_id"), [F.desc("captured_at"), F.desc("order_id"), F.desc("line_no"), F.desc("tie")], 100).select("listing_id", "captured_at", num("price").alias("price")))
query("srt_tree", "SELECT id, row_number() OVER (PARTITION BY parent_id ORDER BY level, lower(name), id)::INT AS place FROM categories")(lambda d: d.categories.select("id", F.row_number().over(W.partitionBy("parent_id").orderBy("level", F.lower("name"), "id")).alias("place")))


@query("srt_probe", "SELECT competitor_id, method, row_number() OVER (PARTITION BY competitor_id ORDER BY score DESC, method)::INT AS place FROM (SELECT competitor_id, coalesce(discovery_source, 'manual') || CASE WHEN is_dead THEN '-dead' ELSE '' END AS method, count(*) AS score FROM listings GROUP BY ALL)")
def srt_probe(d: Domain) -> DataFrame:
    method = F.concat(F.coalesce("discovery_source", F.lit("manual")), F.when(F.col("is_dead"), "-dead").otherwise(""))
    scores = d.listings.groupBy("competitor_id", method.alias("method")).agg(F.count("*").alias("score"))
    return scores.select("competitor_id", "method", F.row_number().over(W.partitionBy("competitor_id").orderBy(F.desc("score"), "method")).alias("place"))


@query("win_merge_topk", "SELECT product_id, listing_id, rn::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY match_score DESC, listing_id) AS rn FROM matches) WHERE rn <= 5")
def win_merge_topk(d: Domain) -> DataFrame:
    # the top five of each batch hold the top five of all
    order = [F.desc("match_score"), F.asc("listing_id")]
    batches = R.first_of(d.matches.withColumn("batch", F.pmod(F.xxhash64("listing_id"), F.lit(8))), ["product_id", "batch"], order, 5)
    return batches.withColumn("place", F.row_number().over(W.partitionBy("product_id").orderBy(*order))).where("place <= 5").select("product_id", "listing_id", "place")


@query("dd_category_nodes", "SELECT name, url FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, url) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(url), url) AS r1 FROM (SELECT url, page_id % 7 AS score, rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS key, lower(regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1)) AS name FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url))) WHERE r1 = 1) WHERE r2 = 1")
def dd_category_nodes(d: Domain) -> DataFrame:
    nodes = d.pages.groupBy("url").agg((F.min("page_id") % 7).alias("score")).withColumn("key", F.regexp_replace(urls.path_of(F.col("url")), "/+$", ""))
    nodes = nodes.withColumn("name", F.lower(F.regexp_extract("key", "([^/]*)$", 1)))
    one = R.first_of(nodes, ["key"], [F.asc(F.length("url")), F.asc("url")])
    return R.first_of(one, ["name"], [F.desc("score"), F.asc("url")]).select("name", "url")


# Sources and sinks -----------------------------------------------------------

#: Columns of the import template and of the export.
TEMPLATE = ("ean", "manufacturer_code", "name", "own_price", "sku", "brand", "category", "model", "color", "size", "storage", "supplier_sku", "product_url")
EXPORT = ("Competitor", "Title", "Category path", "URL", "Brand", "Code", "EAN", "Manufacturer code", "Model", "Shop code", "Extra code", "Size", "Final EUR", "Regular EUR", "Promo EUR", "Old/list EUR", "Currency", "Availability", "Offered by", "Delivered by", "Last checked", "Matched SKU", "Matched name", "Score", "Match", "Status", "Reason")


@query("src_csvtpl", "SELECT unnest(range(1, 14)) AS place, unnest([" + ", ".join(f"'{c}'" for c in TEMPLATE) + "]) AS header")
def src_csvtpl(d: Domain) -> DataFrame:
    return d.spark.createDataFrame(list(enumerate(TEMPLATE, 1)), "place long, header string")


def exported(d: Domain, listings: DataFrame) -> DataFrame:
    """The columns of the export for some listings; fields that the domain doesn't have are null."""
    rows = _roles(d, listings=listings)
    c = d.competitors.select(F.col("id").alias("_c"), F.col("name").alias("_site"))
    t = trees.paths(d.categories).select((F.col("id") - 100).alias("_t"), F.col("path").alias("_path"))
    rows = rows.join(c, rows["competitor_id"] == c["_c"], "left").join(t, rows["category_id"] == t["_t"], "left")
    shown = _shown()
    made = {
        "Competitor": F.col("_site"), "Title": F.col("title"), "Category path": F.coalesce("_path", F.lit("")), "URL": F.col("url"), "Code": F.col("sku"), "EAN": F.col("ean"),
        "Final EUR": num(L.effective_price()), "Regular EUR": num("latest_price"), "Promo EUR": num("latest_promo_price"), "Old/list EUR": num("latest_old_price"), "Currency": L.currency(),
        "Availability": F.col("latest_availability"), "Last checked": F.date_format(L.last_checked(), "yyyy-MM-dd HH:mm"), "Matched SKU": shown[0], "Matched name": shown[1], "Score": num("match_score"),
        "Status": L.row_status(F.col("product_id"), F.col("status")),
    }
    return rows.select("id", "latest_scraped_at", "created_at", *(made.get(n, F.lit(None).cast("string")).alias(n) for n in EXPORT))


@query("snk_xlsx", f"SELECT (row_number() OVER (ORDER BY l.latest_scraped_at DESC NULLS LAST, l.created_at DESC, l.id) + 1)::BIGINT AS row_no, c.name AS competitor, l.url, {_SHOWN['sku']} AS matched_sku, 27 AS n_columns {_ROLES} LEFT JOIN competitors c ON c.id = l.competitor_id WHERE l.competitor_id = 3")
def snk_xlsx(d: Domain) -> DataFrame:
    """The export of a site written as a workbook and read again."""
    folder = scratch(d.spark)
    site = d.listings.where("competitor_id = 3")
    rows = L.page(exported(d, site), L.newest_first(), 50_000)
    workbook.write_workbook(rows.select(*(f"`{n}`" for n in EXPORT)), f"{folder}/export.xlsx", most=None)
    names = [n.lower().replace(" ", "_") for n in EXPORT]
    found = workbook.sheet_rows(workbook.read_workbooks(d.spark, folder), names)
    return found.select("row_no", "competitor", "url", "matched_sku", F.lit(len(names)).alias("n_columns"))


_CLEAN = "CASE WHEN lower(trim({0})) IN ('', '-', 'n/a') THEN NULL ELSE trim({0}) END"
_SHEETS = f"""SELECT batch_id || '.xlsx' AS file, (row_number() OVER (PARTITION BY batch_id ORDER BY row_no) + 1)::BIGINT AS row_no, {', '.join(f"{_CLEAN.format(c)} AS {c}" for c in ('ean', 'manufacturer_code', 'name', 'brand', 'color', 'sku'))}, regexp_replace(model, '[.]0+$', '') AS model, own_price AS said, TRY_CAST(replace(own_price, ',', '.') AS DOUBLE) AS own_price FROM import_rows"""


@query("src_xlsx", f"""SELECT file, row_no, coalesce(nullif(concat_ws('; ', CASE WHEN ean IS NULL THEN 'ean is required' END, CASE WHEN manufacturer_code IS NULL THEN 'manufacturer_code is required' END, CASE WHEN name IS NULL THEN 'name is required' END), ''), CASE WHEN own_price IS NULL THEN 'Invalid own_price: ' || said END) AS error,
  coalesce(sku, ean) AS sku, name, ean, brand, manufacturer_code, model, color, own_price FROM ({_SHEETS})""")
def src_xlsx(d: Domain) -> DataFrame:
    """The rows of imported workbooks, one for each batch, written and read as files."""
    folder = f"{scratch(d.spark)}/imports"
    headers = {"brand": "Brand", "ean": " EAN", "manufacturer_code": "Manufacturer  Code", "name": "name", "sku": "SKU", "row_no": "Ignored", "own_price": "Own Price", "model": "MODEL", "color": "Color"}
    xlsx_source.write_products(d.import_rows, "batch_id", "row_no", headers, folder).collect()  # a row for each file
    rows = upserts.product_rows(xlsx_source.read_products(d.spark, folder))
    return rows.select("file", F.col("row_no").cast("long").alias("row_no"), "error", "sku", "name", "ean", "brand", "manufacturer_code", "model", "color", num("own_price").alias("own_price"))


@query("snk_json", "SELECT (SELECT count(*) FROM products) AS total, 75 AS \"limit\", 75 AS \"offset\", (SELECT count(*) FROM products) > 150 AS has_more, string_agg(id::VARCHAR, ',' ORDER BY name, id) AS ids FROM (SELECT id, name FROM products ORDER BY name, id LIMIT 75 OFFSET 75)")
def snk_json(d: Domain) -> DataFrame:
    """A page as one JSON document, read again."""
    some = L.page(d.products, [F.asc("name"), F.asc("id")], 75, 75).select("name", "id")
    rows = some.agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "id"))), lambda r: r["id"]).alias("rows")).withColumn("_k", F.lit(1))
    total = d.products.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    document = rows.join(total, "_k").select(F.to_json(F.struct("rows", "total", F.lit(75).alias("limit"), F.lit(75).alias("offset"), (F.col("total") > 150).alias("has_more"))).alias("j"))
    p = F.from_json("j", "struct<rows:array<bigint>,total:bigint,limit:int,offset:int,has_more:boolean>")
    return document.select(p.alias("p")).select("p.total", "p.limit", "p.offset", "p.has_more", F.array_join("p.rows", ",").alias("ids"))


@query("snk_table", f"SELECT coalesce(o.sku, g.sku) AS sku, coalesce(g.name, o.name) AS name, coalesce(g.price::DOUBLE, o.own_price::DOUBLE) AS own_price FROM (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY sku ORDER BY id) AS rn FROM products p) WHERE rn = 1) o FULL JOIN (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY sku ORDER BY row_no DESC) AS rn FROM ({_CHECKED}) c WHERE error IS NULL) WHERE rn = 1) g ON g.sku = o.sku")
def snk_table(d: Domain) -> DataFrame:
    """The catalog as a table by SKU after an import was merged into the buckets that it touches."""
    table = KeyedTable(d.spark, f"{scratch(d.spark)}/catalog", "sku string, name string, own_price double", ("sku",))
    merge = newer_wins(table.key, table.schema)
    table.merge(R.first_of(d.products, ["sku"], [F.asc("id")]).select("sku", "name", num("own_price").alias("own_price")), merge)
    good = R.first_of(upserts.checked_rows(d.import_rows).where("error IS NULL"), ["sku"], [F.desc("row_no")])
    table.merge(good.select("sku", "name", num("price").alias("own_price")), merge)
    return table.read()


@query("src_logfields", "SELECT layer, 'layer=' || layer || ' n=' || count(*) || ' ok=' || count(*) FILTER (WHERE outcome = 'scraped') || ' listings=' || count(DISTINCT listing_id) AS line FROM outcomes GROUP BY layer")
def src_logfields(d: Domain) -> DataFrame:
    ok, n, of = F.count_if(F.col("outcome") == "scraped"), F.count("*"), F.count_distinct("listing_id")
    return d.outcomes.groupBy("layer").agg(ok.alias("ok"), n.alias("n"), of.alias("listings")).select("layer", F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in ("layer", "n", "ok", "listings"))).alias("line"))


def _payload(name: str, sql: str):
    return query(name, sql.replace("{t}", "(SELECT k, CASE WHEN n3 = 1 THEN '{\"code\":\"' || n1 || '\"}' ELSE '{\"code\":\"' || n1 || '\",\"name\":\" N' || n2 || ' \",\"price\":{\"value\":' || n2 || ',\"currencyIso\":\"bgn\"},\"stock\":{\"stockLevelStatus\":\"' || coalesce(stock_code, 'inStock') || '\"}}' END AS j FROM cells)"))


def _payloads(d: Domain) -> DataFrame:
    return d.cells.select("k", F.expr("""CASE WHEN n3 = 1 THEN '{"code":"' || n1 || '"}' ELSE '{"code":"' || n1 || '","name":" N' || n2 || ' ","price":{"value":' || n2 || ',"currencyIso":"bgn"},"stock":{"stockLevelStatus":"' || coalesce(stock_code, 'inStock') || '"}}' END""").alias("j"))


_OBSERVED = "SELECT k, trim(j->>'$.name') AS title, (j->>'$.price.value')::DOUBLE AS price, upper(j->>'$.price.currencyIso') AS currency, CASE j->>'$.stock.stockLevelStatus' WHEN 'inStock' THEN 'in_stock' WHEN 'outOfStock' THEN 'out_of_stock' WHEN 'lowStock' THEN 'low_stock' ELSE lower(j->>'$.stock.stockLevelStatus') END AS availability FROM (SELECT k, j::JSON AS j FROM {t}) WHERE (j->>'$.name') IS NOT NULL AND (j->>'$.price.value') IS NOT NULL"


def observed(payloads: DataFrame) -> DataFrame:
    """(k, title, price, currency, availability) of product payloads (k, j); those without name or price give nothing."""
    p = F.from_json("j", "struct<code:string,name:string,price:struct<value:double,currencyIso:string>,stock:struct<stockLevelStatus:string>>")
    rows = payloads.select("k", p.alias("p")).where("p.name IS NOT NULL AND p.price.value IS NOT NULL")
    return rows.select("k", F.trim("p.name").alias("title"), F.col("p.price.value").alias("price"), F.upper("p.price.currencyIso").alias("currency"), fields.stock_code(F.col("p.stock.stockLevelStatus")).alias("availability"))


for _name in ("src_occ", "ex_js_payload"):
    _payload(_name, _OBSERVED)(lambda d: observed(_payloads(d)))

query("ex_json_urls", "SELECT id, 'u' || id AS url FROM feed_items")(lambda d: d.feed_items.select("id", F.explode(markup.json_urls(F.col("item"))).alias("url")))
query("ex_feed_url", "SELECT id, CASE WHEN id % 4 = 0 THEN 'https://c.example/' || id ELSE 'https://shop.example/u' || id END AS url FROM feed_items")(lambda d: d.feed_items.select("id", urls.feed_url(F.when(F.col("id") % 4 == 0, F.concat(F.lit("https://c.example/"), F.col("id").cast("string"))), F.get_json_object("item", "$.url_key"), F.lit("https://shop.example/")).alias("url")))
query("ex_diag_merge", "SELECT layer, max(event_id) AS pages, count(*) AS queries, array_to_string(list_sort(list_distinct(list(error_code) FILTER (WHERE error_code IS NOT NULL))), ';') AS errors FROM outcomes GROUP BY layer")(lambda d: d.outcomes.groupBy("layer").agg(F.max("event_id").alias("pages"), F.count("*").alias("queries"), F.array_join(F.array_sort(F.collect_set("error_code")), ";").alias("errors")))


@query("ex_variant_self", "SELECT id, CASE id % 3 WHEN 0 THEN 'v' || id WHEN 1 THEN 'w' ELSE 'cheap' END AS sku FROM feed_items")
def ex_variant_self(d: Domain) -> DataFrame:
    v = F.array(F.struct(F.lit("w").alias("sku"), F.lit(20.0).alias("price")), F.struct(F.concat(F.lit("v"), F.col("id").cast("string")).alias("sku"), F.lit(30.0).alias("price")), F.struct(F.lit("cheap").alias("sku"), F.lit(5.0).alias("price")))
    own = F.when(F.col("id") % 3 == 0, F.concat(F.lit("v"), F.col("id").cast("string")))
    return d.feed_items.select("id", markup.own_variant(v, own, F.when(F.col("id") % 3 == 1, 20.0))["sku"].alias("sku"))


query("sc_text_blob", "SELECT id, lower(concat_ws(' ', title, brand, model, spec_storage, sku)) AS y FROM offers")(lambda d: d.offers.select("id", M.text_blob(F.col("title"), F.col("brand"), F.col("model"), F.array("spec_storage", "sku")).alias("y")))
query("sc_color", "SELECT k, CASE n3 WHEN 1 THEN 'red ' || n1 WHEN 2 THEN 'green' END AS color, CASE WHEN n3 = 3 THEN n1 || ' gb' ELSE nullif(regexp_extract(lower(code), '(\\d+)\\s*gb\\s*(ram|ddr)', 1), '') END AS memory FROM cells")(lambda d: d.cells.withColumn("specs", F.expr("map('цвят', CASE WHEN n3 = 1 THEN ' Red ' || n1 END, 'colour', CASE WHEN n3 = 2 THEN 'GREEN' END, 'ram', CASE WHEN n3 = 3 THEN n1 || ' GB' END)")).select("k", codes.color_of(F.col("specs")).alias("color"), codes.memory_of(F.col("specs"), F.col("code")).alias("memory")))

# Ingest and discovery ---------------------------------------------------------


@query("st_append_history", "SELECT listing_id, count(*) AS n, max(captured_at) AS newest FROM (SELECT listing_id, captured_at FROM price_snapshots UNION ALL SELECT listing_id, captured_at FROM outcomes) GROUP BY listing_id")
def st_append_history(d: Domain) -> DataFrame:
    return upserts.appended(d.price_snapshots, d.outcomes).groupBy("listing_id").agg(F.count("*").alias("n"), F.max("captured_at").alias("newest"))


@query("st_block_breaker", """
SELECT listing_id, arg_min(event_id, struct_pack(a := captured_at, b := event_id)) AS event_id FROM (SELECT *, sum(bad) OVER (PARTITION BY listing_id, run ORDER BY captured_at, event_id) AS n FROM (
  SELECT *, sum(1 - bad) OVER (PARTITION BY listing_id ORDER BY captured_at, event_id) AS run FROM (SELECT *, coalesce(error_code IN ('playwright_timeout', 'network_error'), false)::INT AS bad FROM outcomes)))
WHERE bad = 1 AND n = 3 GROUP BY listing_id""")
def st_block_breaker(d: Domain) -> DataFrame:
    return health.breaker(d.outcomes, ("playwright_timeout", "network_error"), 3)


_VARIANTS = "SELECT id % 10 + 1 AS competitor_id, 'https://shop' || (id % 10 + 1) || '.example.com/bg/item/' || id || '?' || v AS url FROM (SELECT id, unnest(['utm_source=x', 'v=1', 'v=1']) AS v FROM feed_items)"


@query("st_variant_expand", f"SELECT competitor_id, url, false AS is_new FROM listings GROUP BY ALL UNION ALL SELECT competitor_id, url, true FROM ({_VARIANTS}) v WHERE NOT EXISTS (SELECT 1 FROM listings l WHERE l.competitor_id = v.competitor_id AND l.url = v.url) GROUP BY ALL")
def st_variant_expand(d: Domain) -> DataFrame:
    site = (F.col("id") % 10 + 1).alias("competitor_id")
    url = F.concat(F.lit("https://shop"), site.cast("string"), F.lit(".example.com/bg/item/"), F.col("id").cast("string"), F.lit("?"), F.col("v"))
    v = d.feed_items.select("id", F.explode(F.array(F.lit("utm_source=x"), F.lit("v=1"), F.lit("v=1"))).alias("v")).select(site, url.alias("url"))
    return upserts.with_variants(d.listings, v)




def _known(d: Domain) -> KeyedTable:
    """A store that knows the listings, by site and URL."""
    table = discovery.store(d.spark, f"{scratch(d.spark)}/discovered")
    discovery.discover(table, d.listings.select(F.col("competitor_id").cast("long").alias("site"), "url", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("category")), 0, "listings")
    return table


def _page_items(pages: DataFrame) -> DataFrame:
    """Items of site 0 from the URLs of pages, in the category that the path begins with."""
    first = F.nullif(F.regexp_extract("url", "^https?://[^/?#]+/([^/?#]+)", 1), F.lit(""))
    return pages.select(F.lit(0).cast("long").alias("site"), "url", F.lit(None).cast("string").alias("code"), first.alias("category"))


_DISCOVERED = "SELECT DISTINCT competitor_id::BIGINT AS site, url, {} AS category FROM listings UNION ALL SELECT DISTINCT 0, url, nullif(regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)', 1), '') FROM pages WHERE url IS NOT NULL"


@query("st_incremental_discovery", _DISCOVERED.format("NULL"))
def st_incremental_discovery(d: Domain) -> DataFrame:
    """The listings known after a stream of page URLs, a file to a micro-batch, has met the store."""
    table, folder = _known(d), scratch(d.spark)
    urls_ = d.pages.select("url")
    urls_.repartition(3).write.parquet(f"{folder}/arrivals")
    found = d.spark.readStream.schema(urls_.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrivals")
    discovery.discovery_stream(_page_items(found), table, f"{folder}/offsets").awaitTermination()
    return discovery.listings(table).select("site", "url", "category")


@query("up_discovered_products", _DISCOVERED.format("CASE WHEN competitor_id = 3 THEN 'known' END"))
def up_discovered_products(d: Domain) -> DataFrame:
    """The listings after a batch of items: new ones with their category, known ones of a site with one that they lacked."""
    table = _known(d)
    again = d.listings.where("competitor_id = 3").select(F.col("competitor_id").cast("long").alias("site"), "url", F.lit(None).cast("string").alias("code"), F.lit("known").alias("category"))
    discovery.discover(table, _page_items(d.pages).unionByName(again), 1)
    return discovery.listings(table).select("site", "url", "category")


@query("up_listing_url", "SELECT r.id AS request_id, CASE WHEN l.competitor_id = r.site THEN l.id END AS listing_id, CASE WHEN l.id IS NULL THEN 'created' WHEN l.competitor_id = r.site THEN 'existing' ELSE 'conflict' END AS result FROM (SELECT id, id % 10 + 1 AS site, 'https://shop' || (id % 7 + 1) || '.example.com/bg/item/' || id || '?utm_source=x' AS url FROM products) r LEFT JOIN (SELECT url, arg_min(competitor_id, id) AS competitor_id, min(id) AS id FROM listings GROUP BY url) l ON l.url = r.url")
def up_listing_url(d: Domain) -> DataFrame:
    url = F.concat(F.lit("https://shop"), (F.col("id") % 7 + 1).cast("string"), F.lit(".example.com/bg/item/"), F.col("id").cast("string"), F.lit("?utm_source=x"))
    return upserts.requested(d.listings, d.products.select(F.col("id").alias("request_id"), (F.col("id") % 10 + 1).alias("competitor_id"), url.alias("url")))


# Categories --------------------------------------------------------------------


@query("up_replace_tree", "WITH RECURSIVE gone AS (SELECT id FROM categories WHERE parent_id = 2 UNION SELECT c.id FROM categories c JOIN gone g ON c.parent_id = g.id) SELECT id, parent_id, name, level FROM categories WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 900000 + s_suppkey, 2, s_name, 1 FROM supplier")
def up_replace_tree(d: Domain) -> DataFrame:
    new = d.supplier.select((F.col("s_suppkey") + 900000).alias("id"), F.lit(2).alias("parent_id"), F.col("s_name").alias("name"), F.lit(1).alias("level"))
    return upserts.replaced_tree(d.categories, new, d.categories.where("id = 2"))


@query("tr_get_or_create", "SELECT r.id AS request_id, coalesce(CASE WHEN r.id % 6 = 0 THEN 77 END, c.id) AS category_id, CASE WHEN r.id % 6 = 0 THEN false ELSE c.id IS NULL END AS is_new FROM products r LEFT JOIN (SELECT parent_id, lower(name) AS n, min(id) AS id FROM categories GROUP BY ALL) c ON c.parent_id = r.id % 7 AND c.n = CASE r.id % 7 WHEN 0 THEN 'algeria' WHEN 1 THEN 'canada' ELSE 'nowhere' END")
def tr_get_or_create(d: Domain) -> DataFrame:
    asked = d.products.selectExpr("id AS request_id", "CASE WHEN id % 6 = 0 THEN 77 END AS category_id", "id % 7 AS parent_id", "CASE id % 7 WHEN 0 THEN 'ALGERIA' WHEN 1 THEN 'Canada' ELSE 'Nowhere' END AS name")
    return upserts.categories_for(asked, d.categories)


_PATHS = "RECURSIVE t(id, path) AS (SELECT id, name FROM categories WHERE parent_id IS NULL UNION ALL SELECT c.id, t.path || ' > ' || c.name FROM categories c JOIN t ON c.parent_id = t.id)"


@query("tr_display_path", f"WITH {_PATHS} SELECT l.id, CASE WHEN l.part_id % 5 = 0 THEN 'Crumb > ' || l.sku ELSE coalesce(t.path, 'Uncategorized') END AS path FROM listings l LEFT JOIN t ON t.id = l.category_id + 100")
def tr_display_path(d: Domain) -> DataFrame:
    t = trees.paths(d.categories).select((F.col("id") - 100).alias("category_id"), "path")
    crumbs = F.when(F.col("part_id") % 5 == 0, F.array(F.lit("Crumb"), F.col("sku")))
    return d.listings.join(t, "category_id", "left").select("id", trees.display_path(crumbs, F.lit(None).cast("string"), F.col("path")).alias("path"))


@query("q_workspace_legacy", f"SELECT l.id, s.price::DOUBLE AS price, b.status FROM listings l LEFT JOIN ({_LATEST}) s ON s.listing_id = l.id LEFT JOIN (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY listing_id ORDER BY CASE status WHEN 'confirmed' THEN 0 WHEN 'auto_matched' THEN 1 WHEN 'needs_review' THEN 2 ELSE 3 END, match_score DESC, product_id) AS rn FROM matches m) WHERE rn = 1) b ON b.listing_id = l.id WHERE l.category_id = 4")
def q_workspace_legacy(d: Domain) -> DataFrame:
    rows = d.listings.where("category_id = 4").select("id")
    ids = rows.select(F.col("id").alias("listing_id"))
    s = d.latest_prices.join(ids, "listing_id", "left_semi").select(F.col("listing_id").alias("id"), num("price").alias("price"))
    b = R.best_match_legacy(d.matches.join(ids, "listing_id", "left_semi")).select(F.col("listing_id").alias("id"), "status")
    return rows.join(s, "id", "left").join(b, "id", "left")
