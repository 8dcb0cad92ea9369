"""Queries over extraction from markup, feeds and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions import dom, fields, json_ld, markup, product_urls, urls
from tallymart.operators import frontier, pages, price_pages, upserts
from tallymart.operators.listings import page_variants
from tallymart.operators.ranking import first_of
from tallymart.plans.registry import query
from tallymart.plans.scalars import scalar
from tallymart.sources.adapters import Domain
from tallymart.sources.tree import with_nodes


def over(table: str, name: str, column: str, f, sql: str) -> None:
    """A query (id, y) of ``f`` over a column of a table, and its SQL over ``x``."""
    query(name, f"SELECT id, {sql} AS y FROM (SELECT *, {column} AS x FROM {table})")(lambda d: getattr(d, table).select("id", f(F.col(column)).alias("y")))


_N = "id::VARCHAR"


@query("src_sitemap", r"""WITH RECURSIVE named AS (SELECT url AS at, unnest(CASE WHEN body LIKE '%<rss%' THEN [] WHEN body LIKE '%<loc>%' THEN regexp_extract_all(body, '<loc>\s*(.*?)\s*</loc>', 1) ELSE list_filter(string_split(body, chr(10)), lambda u: u LIKE 'http%') END) AS loc FROM sitemap_files),
seen AS (SELECT 'https://shop.example/sitemap-1.xml' AS url UNION SELECT n.loc FROM named n JOIN seen s ON n.at = s.url WHERE n.loc LIKE '%sitemap%')
SELECT url, 'sitemap' AS kind FROM seen UNION SELECT replace(n.loc, '&amp;', '&'), 'page' FROM named n JOIN seen s ON n.at = s.url WHERE n.loc NOT LIKE '%sitemap%'
UNION SELECT unnest(regexp_extract_all(f.body, '<item>.*?<link>(.*?)</link>', 1)), 'page' FROM sitemap_files f JOIN seen s USING (url) WHERE f.body LIKE '%<rss%'""")
def src_sitemap(d: Domain) -> DataFrame:
    """All pages and sitemaps that are reached from the first sitemap of a shop."""
    return frontier.followed(d.sitemap_files, d.sitemap_files.where("url LIKE '%/sitemap-1.xml'").select("url"))


over("shop_pages", "ex_gtag", "html", lambda x: markup.event_price(x).cast("double"), "nullif(regexp_extract(x, 'view_item.*\"price\": \"([\\d.]+)\"', 1), '')::DOUBLE")
over("shop_pages", "ex_ean", "html", markup.labelled_ean, "regexp_extract(x, 'EAN: (\\d{13})', 1)")
over("shop_pages", "ex_mpn", "html", markup.mpn_of, "nullif(regexp_extract(x, '\"mpn\":\"(.*?)\"', 1), '')")
over("shop_pages", "ex_seller", "html", markup.seller, "regexp_extract(x, 'Sold by: ([^<]*)<', 1)")
_FOUND = "list_filter(list_distinct(list_transform(regexp_extract_all(x, '<a [^>]*href=\"(/[^\"#?]*)', 1), lambda h: 'https://shop.example' || h)), lambda u: regexp_matches(u, '/p/[0-9]{3,}$'))"
over("shop_pages", "ex_links", "html", lambda x: F.concat_ws(" ", F.array_join(F.filter(F.transform(markup.links(x, F.col("url")), urls.product_url), product_urls.is_dynamic_product), " "), markup.next_page(x)), f"array_to_string({_FOUND}, ' ') || ' ' || regexp_extract(x, '<a rel=\"next\" href=\"([^\"]*)', 1)")
over("shop_pages", "ex_jsonld_merge", "html", lambda x: F.to_json(markup.filled(F.struct(F.lit("unknown").alias("availability"), F.lit(None).cast("string").alias("brand"), markup.title_of(x).alias("title")), markup.json_ld_product(x), ("availability", "brand", "title"))), "CASE WHEN contains(x, 'ld+json') THEN '{\"availability\":\"in_stock\",\"brand\":\"' || regexp_extract(x, '\"brand\":\\{\"name\":\"(.*?)\"', 1) || '\",' ELSE '{' END || '\"title\":\"' || regexp_extract(x, '<h1>(.*?)</h1>', 1) || '\"}'")

_BARCODE = f"CASE WHEN id % 2 = 0 THEN {_N} ELSE {_N} END"
over("feed_items", "ex_bulk_entries", "item", lambda x: F.array_join(F.transform(markup.feed_entries(x), lambda e: F.concat(e["sku"], F.lit("="), F.coalesce(e["ean"], F.lit("-")))), ";"), f"CASE WHEN id % 6 = 0 THEN 'a' || {_N} || '=' || {_N} || ';b' || {_N} || '=2' WHEN id % 3 = 0 THEN 'a' || {_N} || '=-;b' || {_N} || '=-' ELSE (x::JSON->>'$.sku') || '=' || {_N} END")
over("feed_items", "ex_bulk_to_obs", "item", lambda x: F.array_join(F.transform(markup.feed_entries(x), lambda e: F.concat_ws(":", *(markup.observation_of_entry(e, F.get_json_object(x, "$.name"))[k] for k in ("sku", "brand", "status")))), ";"), "CASE WHEN id % 3 = 0 THEN 'a' || id || ':' || split_part(x::JSON->>'$.name', ' ', 1) || ':success;b' || id || ':' || split_part(x::JSON->>'$.name', ' ', 1) || ':success' ELSE (x::JSON->>'$.sku') || ':' || split_part(x::JSON->>'$.name', ' ', 1) || CASE WHEN (x::JSON->>'$.price') IS NULL THEN ':failed' ELSE ':success' END END")


def _entries(d: Domain) -> DataFrame:
    return d.feed_items.select("id", F.explode(markup.feed_entries(F.col("item"))).alias("e")).select("id", "e.*")


_ENTRIES = "SELECT id, unnest(CASE WHEN id % 3 = 0 THEN ['a' || id, 'b' || id] ELSE [item::JSON->>'$.sku'] END) AS sku, 'u' || id AS url FROM feed_items"


@query("dd_feed_sku", f"SELECT sku, min(id) AS id FROM ({_ENTRIES}) GROUP BY sku")
def dd_feed_sku(d: Domain) -> DataFrame:
    return first_of(_entries(d), ["sku"], [F.asc("id"), F.asc("url")]).select("sku", "id")


_PLACE = "right(repeat('0', 40) || bin(greatest(0, round(coalesce((item::JSON->>'$.price')::DOUBLE, 0) * 100)::BIGINT)), 40) || right(repeat('0', 64) || bin(('0x' || substr(md5(id::VARCHAR), 1, 16))::UBIGINT), 64)"


@query("src_graphql", f"""WITH b AS (SELECT id, {_PLACE} AS bits FROM feed_items),
p AS (SELECT id, d::INT AS depth, substr(bits, 1, d::INT) AS page FROM b, range(0, 105) AS g(d)),
t AS (SELECT depth, page, count(*) AS page_items FROM p GROUP BY depth, page),
o AS (SELECT id, min(p.depth) AS depth FROM p JOIN t USING (depth, page) WHERE page_items <= 100 GROUP BY id)
SELECT o.id, p.page, t.page_items FROM o JOIN p ON p.id = o.id AND p.depth = o.depth JOIN t ON t.depth = p.depth AND t.page = p.page""")
def src_graphql(d: Domain) -> DataFrame:
    """The page of each feed item when ranges of prices are halved until they fit a page of 100."""
    items = d.feed_items.select("id", F.get_json_object("item", "$.price").cast("double").alias("price"))
    return price_pages.price_pages(items, "price", "id", 100).select("id", "page", "page_items")


@query("ex_find_in_feed", f"SELECT p.id, min(e.id) AS item_id FROM products p JOIN ({_ENTRIES}) e ON e.url = 'u' || p.id OR e.sku = 'P' || p.id GROUP BY p.id")
def ex_find_in_feed(d: Domain) -> DataFrame:
    # the two keys of an entry as rows, so that one equi-join serves both
    keys = _entries(d).select(F.col("id").alias("item_id"), F.explode(F.array(F.concat(F.lit("url:"), "url"), F.concat(F.lit("sku:"), "sku"))).alias("key"))
    own = d.products.select("id", F.explode(F.array(F.concat(F.lit("url:u"), F.col("id").cast("string")), F.concat(F.lit("sku:P"), F.col("id").cast("string")))).alias("key"))
    return own.join(keys, "key").groupBy("id").agg(F.min("item_id").alias("item_id"))


@query("jn_url_key_bulk", "SELECT l.id, f.id AS item_id FROM (SELECT id, url, row_number() OVER (PARTITION BY regexp_replace(url, '^https?://|[?].*$', '', 'g') ORDER BY id) AS rn FROM listings) l JOIN (SELECT id, 'https://shop' || (id % 10 + 1) || '.example.com/bg/item/' || id AS url FROM feed_items) f ON regexp_replace(l.url, '^https?://|[?].*$', '', 'g') = regexp_replace(f.url, '^https?://', '') WHERE l.rn = 1")
def jn_url_key_bulk(d: Domain) -> DataFrame:
    first = first_of(d.listings.select("id", urls.match_key(F.col("url")).alias("key")), ["key"], [F.asc("id")])
    site = F.concat(F.lit("https://shop"), (F.col("id") % 10 + 1).cast("string"), F.lit(".example.com/bg/item/"), F.col("id").cast("string"))
    return d.feed_items.select(F.col("id").alias("item_id"), urls.match_key(site).alias("key")).join(first, "key").select("id", "item_id")


def _number(c: str) -> Column:
    return F.col(c).cast("double")


query("agg_eta", "SELECT site_id, CASE WHEN sum(l_ok) > 0 THEN ceil(sum(1 - l_ok) / sum(l_ok)::DOUBLE)::BIGINT END AS minutes FROM (SELECT competitor_id AS site_id, (latest_scraped_at IS NOT NULL)::INT AS l_ok FROM listings) GROUP BY site_id")(lambda d: d.listings.groupBy(F.col("competitor_id").alias("site_id")).agg(F.count_if(F.col("latest_scraped_at").isNull()).alias("rest"), F.count("latest_scraped_at").alias("done")).select("site_id", fields.minutes_left(F.col("rest"), F.col("done")).alias("minutes")))
query("st_heartbeat", "SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 300 SECONDS AS stalled FROM events")(lambda d: d.events.withColumn("_k", F.lit(1)).join(d.events.agg(F.max("ts").alias("now")).withColumn("_k", F.lit(1)), "_k").select("event_id", fields.stalled(F.col("ts"), F.col("now")).alias("stalled")))
query("sc_first_text", "SELECT id, coalesce(nullif(trim(brand), ''), nullif(trim(model), ''), nullif(trim(name), '')) AS y FROM products")(lambda d: d.products.select("id", fields.first_text(F.col("brand"), F.col("model"), F.col("name")).alias("y")))


@query("q_discovery_upsert", "SELECT key, min(url) AS url FROM (SELECT url, rtrim(regexp_replace(lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', ''), '/') AS key FROM pages) WHERE key NOT IN (SELECT rtrim(split_part(url, '?', 1), '/') FROM listings) GROUP BY key")
def q_discovery_upsert(d: Domain) -> DataFrame:
    """New canonical product URLs of the pages, against those of all listings."""
    key = lambda x: F.concat(F.lower(F.regexp_extract(x, "^(https?://[^/?#]*)", 1)), F.regexp_replace(urls.path_of(x), "/+$", ""))
    return upserts.undiscovered(d.pages.select("url"), d.listings.select("url"), key)


@query("js_variants", """SELECT id, url, '30ML' AS size, regexp_extract(html, 'additionalInfo":"цвят (F\\d+) ', 1) AS color, regexp_extract(html, '"value":(\\d+),"currency"', 1)::DOUBLE AS price, nullif(regexp_extract(html, '"value":(\\d+),"type":"Recommended"', 1), '')::DOUBLE AS regular,
  upper(regexp_extract(html, '"currency":"(.*?)"', 1)) AS currency, NULL AS ean, regexp_extract(html, '"productCode":"(.*?)"', 1) AS manufacturer_code, regexp_extract(html, '"name":"(.*?)"', 1) AS title FROM variant_pages
UNION ALL SELECT id, 'https://shop.example/cream/p-9/', NULL, 'red', nullif(regexp_extract(html, '"price":\\{"value":(\\d+)\\}', 1), '')::DOUBLE, NULL, NULL, regexp_extract(html, '"eanCode":"(\\d+)"', 1), NULL, NULL FROM variant_pages WHERE url NOT LIKE '%/p-9/'""")
def js_variants(d: Domain) -> DataFrame:
    return page_variants(d.variant_pages).select("id", "url", "size", "color", "price", "regular", "currency", "ean", "manufacturer_code", "title")


@query("ex_swatch", """SELECT id, CASE WHEN contains(html, 'opt Selected') THEN '50ML' WHEN contains(html, 'opt active') THEN '100ML' ELSE '75ML' END AS size, replace(coalesce(nullif(regexp_extract(html, 'Selected">50 мл ([\\d,]+)', 1), ''), nullif(regexp_extract(html, '€ ([\\d.]+)</div>', 1), '')), ',', '.')::DOUBLE AS price,
  replace(nullif(regexp_extract(html, 'Selected">50 мл [\\d,]+ € ([\\d,]+)', 1), ''), ',', '.')::DOUBLE AS promo, CASE WHEN contains(html, 'opt Selected') OR contains(html, 'opt active') THEN 'EUR' END AS currency FROM variant_pages""")
def ex_swatch(d: Domain) -> DataFrame:
    return d.variant_pages.select("id", markup.swatch(F.col("html")).alias("s")).select("id", "s.*")


# Pages by their tree ---------------------------------------------------------


def _sql_head(x: str) -> str:
    return f"(CASE json_type({x}) WHEN 'ARRAY' THEN {x}->'$[0]' ELSE {x} END)"


def _sql_plain(x: str) -> str:
    return f"nullif(trim({x}), '')"


def _sql_word(x: str) -> str:
    one = _sql_head(x)
    keys = ", ".join(_sql_plain(f"{one}->>'$.\"{k}\"'") for k in ("url", "name", "@id"))
    return f"(CASE json_type({one}) WHEN 'OBJECT' THEN coalesce({keys}) ELSE {_sql_plain(f"{one}->>'$'")} END)"


_SQL_VALID = "len(d) IN (8, 12, 13, 14) AND list_sum(list_transform(range(1, len(d) + 1), lambda i: d[i]::INT * CASE WHEN (len(d) - i) % 2 = 1 THEN 3 ELSE 1 END)) % 10 = 0"
_SQL_OFFER = _sql_head("p->'$.offers'")
_SQL_SAID = lambda k: f"nullif({_sql_plain(_sql_head(f"{_SQL_OFFER}->'$.{k}'") + "->>'$'")}, '0')"
_SQL_STOCK = f"regexp_replace(lower({_SQL_OFFER}->>'$.availability'), '[^a-z0-9]+', '', 'g')"
_SQL_BRAND = _sql_head("p->'$.brand'")

#: SQL: the objects of each page's JSON-LD in the order of the walk, and the fields of the first product.
_WALK = """WITH RECURSIVE walk AS (
  SELECT id, [i] AS o, b::JSON AS j FROM (SELECT id, unnest(b) AS b, generate_subscripts(b, 1) AS i FROM (SELECT id, regexp_extract_all(html, '(?s)<script type=["'']application/ld\\+json["'']>(.*?)</script>', 1) AS b FROM product_pages)) WHERE json_valid(b)
  UNION ALL
  SELECT id, list_append(o, i), x FROM (SELECT id, o, unnest(kids) AS x, generate_subscripts(kids, 1) AS i FROM (SELECT id, o, CASE json_type(j) WHEN 'ARRAY' THEN j->'$[*]' WHEN 'OBJECT' THEN list_concat(coalesce(j->'$."@graph"[*]', []), list_filter([j->'$.offers', j->'$.itemListElement', j->'$.mainEntity', j->'$.isVariantOf'], lambda v: v IS NOT NULL)) ELSE [] END AS kids FROM walk)) WHERE json_type(x) IN ('ARRAY', 'OBJECT')),
obj AS (SELECT id, o, j, coalesce(j->>'$."@type"', '') AS kind FROM walk WHERE json_type(j) = 'OBJECT')"""
_PRODUCT = f"""{_WALK},
prod AS (SELECT id, arg_min(j, o) AS p FROM obj WHERE contains(lower(kind), 'product') GROUP BY id),
ld AS (SELECT id, {_sql_word("p->'$.name'")} AS title, CASE json_type({_SQL_BRAND}) WHEN 'OBJECT' THEN {_sql_word(_SQL_BRAND + "->'$.name'")} ELSE {_sql_word("p->'$.brand'")} END AS brand,
  list_filter([{", ".join("regexp_replace(" + _sql_word(f"p->'$.{k}'") + ", '[^0-9]', '', 'g')" for k in json_ld.GTINS)}], lambda d: {_SQL_VALID})[1] AS ean, {_sql_word("p->'$.mpn'")} AS mpn, {_sql_word("p->'$.sku'")} AS sku,
  replace(coalesce({_SQL_SAID("price")}, {_SQL_SAID("lowPrice")}), ',', '.')::DOUBLE AS price, upper({_SQL_SAID("priceCurrency")}) AS currency,
  CASE WHEN contains({_SQL_STOCK}, 'instock') THEN 'in_stock' WHEN contains({_SQL_STOCK}, 'outofstock') OR contains({_SQL_STOCK}, 'soldout') THEN 'out_of_stock' WHEN contains({_SQL_STOCK}, 'preorder') THEN 'preorder' END AS availability, {_sql_word("p->'$.image'")} AS image FROM prod)"""

_LD = ("title", "brand", "ean", "mpn", "sku", "price", "currency", "availability", "image")


@query("src_jsonld", f"{_WALK} SELECT id, count(*) AS objects, string_agg(kind, ' ' ORDER BY o) AS types FROM obj GROUP BY id")
def src_jsonld(d: Domain) -> DataFrame:
    """The objects of each page's JSON-LD: how many, and their types in the order of the walk."""
    seen = d.product_pages.select("id", json_ld.objects(markup.json_ld(F.coalesce("html", F.lit("")))).alias("seen")).where(F.size("seen") > 0)
    return seen.select("id", F.size("seen").cast("long").alias("objects"), F.array_join(F.transform("seen", json_ld.type_of), " ").alias("types"))


@query("ex_jsonld_product", f"{_PRODUCT} SELECT id, {', '.join(_LD)} FROM ld")
def ex_jsonld_product(d: Domain) -> DataFrame:
    """The first product of each page's JSON-LD, where it has one."""
    found = with_nodes(d.product_pages).select("id", json_ld.product(dom.scripts(F.col("nodes"))).alias("p"))
    return found.select("id", *(F.col(f"p.{c}").alias(c) for c in _LD)).where("title IS NOT NULL")


#: SQL: what the tree gives, read off the markup. Related products end at a comment.
_OWN = """own AS (SELECT id, url, html, regexp_replace(html, '(<div class="related-items">|<a href="/bg/p/other">).*?<!--/noise-->', '', 'g') AS x, trim(regexp_replace(replace(regexp_replace(regexp_replace(html, '<(title|script)[^>]*>.*?</(title|script)>', '', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS body FROM product_pages),
css AS (SELECT *, coalesce(nullif(regexp_extract(x, '<meta property="product:price:amount" content="([^"]*)"', 1), ''), nullif(regexp_extract(x, 'data-price="([^"]*)"', 1), ''), nullif(regexp_extract(x, 'class=["'']price["'']>([^<]*)<', 1), '')) AS shown,
  CASE WHEN contains(x, 'product:price:amount') THEN 'meta[property="product:price:amount"]' WHEN contains(x, 'data-price=') THEN '[data-price]' WHEN regexp_matches(x, 'class=["'']price["'']') THEN '.price' END AS selector,
  replace(coalesce(nullif(regexp_extract(x, '<(?:s|del)>([\\d,]+)', 1), ''), nullif(regexp_extract(x, '"old-price">([\\d,]+)', 1), '')), ',', '.')::DOUBLE AS old FROM own),
priced AS (SELECT *, replace(regexp_extract(shown, '\\d+[.,]\\d+'), ',', '.')::DOUBLE AS amount, CASE WHEN contains(shown, 'лв') THEN 'BGN' WHEN contains(shown, '€') OR contains(shown, 'EUR') THEN 'EUR' END AS money,
  CASE WHEN contains(x, '<s>') OR contains(x, '<del>') THEN CASE WHEN contains(x, '<s>') THEN 's' ELSE 'del' END WHEN contains(x, '"old-price"') THEN '.old-price' END AS old_selector FROM css)"""


@query("ex_price_selector", f"WITH {_OWN} SELECT id, amount AS price, money AS currency, selector, old, old_selector FROM priced WHERE shown IS NOT NULL OR old IS NOT NULL")
def ex_price_selector(d: Domain) -> DataFrame:
    """The price and the old price that the selectors find outside noise, and which selectors."""
    n = F.col("nodes")
    found = with_nodes(d.product_pages).select("id", dom.first_price(n, F.col("url"), dom.PRICES).alias("p"), dom.first_price(n, F.col("url"), dom.OLD_PRICES).alias("o"))
    return found.select("id", F.col("p.amount").cast("double").alias("price"), F.col("p.currency").alias("currency"), F.col("p.selector").alias("selector"), F.col("o.amount").cast("double").alias("old"), F.col("o.selector").alias("old_selector")).where("price IS NOT NULL OR old IS NOT NULL")


_TITLE = """coalesce(nullif(regexp_extract(html, '<meta property="og:title" content="([^"]*)"', 1), ''), trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')))"""
_IMAGE = "url || nullif(regexp_extract(html, '<img class=\"product-image\" src=\"([^\"]*)\"', 1), '')"


@query("ex_title_image", f"SELECT id, nullif({_TITLE}, '') AS title, {_IMAGE} AS image FROM product_pages")
def ex_title_image(d: Domain) -> DataFrame:
    return with_nodes(d.product_pages).select("id", dom.title(F.col("nodes")).alias("title"), dom.image(F.col("nodes"), F.col("url")).alias("image"))


_STRIP = lambda x: f"nullif(trim(regexp_replace({x}, '<[^>]+>', '', 'g')), '')"


@query("ex_specs", f"""{_PRODUCT} SELECT id, concat_ws('; ', 'brand: ' || coalesce({_STRIP("regexp_extract(html, '<dt>Марка<dd>(.*?)</dl>', 1)")}, ld.brand), 'color: ' || {_STRIP("regexp_extract(html, '<th>Цвят:</th><td>(.*?)</td>', 1)")}, 'ean: ' || ld.ean, 'manufacturer_code: ' || ld.mpn,
  'memory: ' || {_STRIP("regexp_extract(html, '<li>RAM: ([^<]*)', 1)")}, 'model: ' || {_STRIP("regexp_extract(html, '<li><b>Модел</b>([^<]*)', 1)")}) AS y FROM product_pages LEFT JOIN ld USING (id)""")
def ex_specs(d: Domain) -> DataFrame:
    return with_nodes(d.product_pages).select("id", fields.attributes_text(pages.specs(F.col("nodes"))).alias("y"))


@query("ex_breadcrumbs", f"SELECT id, CASE WHEN contains(lower({_TITLE}), lower(t)) THEN '' ELSE coalesce(t, '') END AS y FROM (SELECT *, nullif(regexp_extract(html, '<a href=\"/c/1\">(.*?)</a>', 1), '') AS t FROM product_pages)")
def ex_breadcrumbs(d: Domain) -> DataFrame:
    return with_nodes(d.product_pages).select("id", F.array_join(pages.trail(F.col("nodes"), dom.title(F.col("nodes"))), ">").alias("y"))


@query("ex_site_price", r"""SELECT id, price, CASE WHEN old > price THEN old END AS old, CASE WHEN old > price THEN price END AS promo FROM (
  SELECT id, coalesce(own, list_min(t)) AS price, coalesce(struck, CASE WHEN own IS NULL AND len(t) > 1 THEN list_max(t) END) AS old FROM (
    SELECT id, list_transform(regexp_extract_all(html, 'class=["'']price["'']>([\d,]+) лв', 1), lambda v: replace(v, ',', '.')::DOUBLE)[1] AS own, list_max(list_transform(regexp_extract_all(html, '<(?:s|del)>([\d,]+) лв', 1), lambda v: replace(v, ',', '.')::DOUBLE)) AS struck,
      list_transform(regexp_extract_all(html, '([\d,]+) лв', 1), lambda v: replace(v, ',', '.')::DOUBLE) AS t FROM product_pages)) WHERE price IS NOT NULL""")
def ex_site_price(d: Domain) -> DataFrame:
    """Prices in leva as one shop's pages show them."""
    p = with_nodes(d.product_pages).select("id", pages.site_price(F.col("nodes")).alias("p"))
    return p.select("id", *(F.col(f"p.{c}").cast("double").alias(c) for c in ("price", "old", "promo"))).where("price IS NOT NULL")


#: SQL of a page's fields: the variant before the structured price before the selectors', the event in place of the latter.
_PAGE = f"""{_PRODUCT}, {_OWN},
var AS (SELECT id, regexp_replace(regexp_extract(html, 'class="opt selected">(.*?)</div>', 1), '<[^>]+>', ' ', 'g') AS v FROM product_pages),
sw AS (SELECT id, upper(replace(replace(nullif(regexp_extract(v, '\\d+ (?:мл|ml)'), ''), ' ', ''), 'мл', 'ml')) AS size, list_transform(regexp_extract_all(v, '([\\d,]+) €', 1), lambda a: replace(a, ',', '.')::DOUBLE) AS euro FROM var),
joined AS (SELECT c.*, ld.title AS ld_title, ld.price AS ld_price, ld.currency AS ld_currency, ld.availability AS ld_stock, ld.image AS ld_image, ld.ean AS ld_ean, ld.mpn AS ld_mpn, ld.brand, sw.size, sw.euro[1] AS v_price, list_filter(sw.euro, lambda e: e < sw.euro[1])[1] AS v_promo,
  nullif(regexp_extract(html, 'view_item.*?"price": "([\\d.]+)"', 1), '')::DOUBLE AS e_price, upper(nullif(regexp_extract(html, 'view_item.*?"currency":"(.*?)"', 1), '')) AS e_currency FROM priced c LEFT JOIN ld USING (id) LEFT JOIN sw USING (id)),
told AS (SELECT *, v_price IS NULL AND ld_price IS NULL AND e_price IS NOT NULL AS by_event FROM joined),
page AS (SELECT id, nullif(coalesce(ld_title, {_TITLE}), '') AS title, CASE WHEN by_event THEN e_price ELSE coalesce(v_price, ld_price, amount) END AS price, old, v_promo,
  CASE WHEN by_event THEN coalesce(e_currency, money, 'BGN') WHEN v_price IS NOT NULL THEN 'EUR' WHEN ld_price IS NOT NULL THEN ld_currency ELSE coalesce(money, 'BGN') END AS currency,
  CASE WHEN by_event THEN 'gtag_view_item' WHEN v_price IS NOT NULL THEN '.swatch-attribute.size .selected' WHEN ld_price IS NOT NULL THEN 'json_ld' ELSE selector END AS source,
  coalesce(ld_stock, CASE WHEN regexp_matches(body, '(?i)\\b(in stock|available)\\b') THEN 'in_stock' END) AS availability, coalesce(ld_image, {_IMAGE}) AS image, coalesce(ld_ean, nullif(regexp_extract(body, 'EAN: (\\d{{13}})', 1), '')) AS ean, coalesce(ld_mpn, nullif(regexp_extract(body, 'Модел: ([A-Za-z0-9.-]+)', 1), '')) AS manufacturer_code, brand, size,
  ld_price, EXISTS (SELECT 1 FROM obj WHERE obj.id = told.id AND kind = 'ItemList') AND ld_title IS NULL AS listing FROM told)"""
_FIELDS = ("title", "price", "old", "promo", "currency", "source", "availability", "image", "ean", "manufacturer_code", "brand", "size", "confidence", "listing")


@query("ex_page", f"""{_PAGE} SELECT id, title, price, old, coalesce(v_promo, CASE WHEN price < old THEN price END) AS promo, CASE WHEN price IS NOT NULL THEN currency END AS currency, source, availability, image, ean, manufacturer_code, brand, size,
  CASE WHEN title IS NOT NULL AND ld_price IS NOT NULL THEN 'high' WHEN title IS NOT NULL AND price IS NOT NULL THEN 'medium' WHEN title IS NOT NULL OR price IS NOT NULL THEN 'low' ELSE 'none' END AS confidence, listing FROM page""")
def ex_page(d: Domain) -> DataFrame:
    """All fields of product pages in ten layouts, empty and missing ones included."""
    return pages.observed_pages(d.product_pages).select("id", *(F.col(f"page.{c}").alias(c) for c in _FIELDS))


query("sc_confidence", f"{_PAGE} SELECT id, CASE WHEN title IS NOT NULL AND ld_price IS NOT NULL THEN 'high' WHEN title IS NOT NULL AND price IS NOT NULL THEN 'medium' WHEN title IS NOT NULL OR price IS NOT NULL THEN 'low' ELSE 'none' END AS y FROM page")(lambda d: pages.observed_pages(d.product_pages).select("id", F.col("page.confidence").alias("y")))


@query("src_html", r"""WITH raw AS (SELECT 'shop' AS kind, id AS page_id, html FROM shop_pages UNION ALL SELECT 'given', page_id, html FROM pages),
read AS (SELECT kind, page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(html, '"Product","name":"(.*?)"', 1), ''), nullif(regexp_extract(html, '<meta property="og:title" content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), '<[^>]+>', ' ', 'g'), '&(lt|gt|amp|quot)\b;?', '&\1;', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title,
  nullif(regexp_extract(html, '"offers":\{"price":"([\d.]+)"', 1), '')::DOUBLE AS ld_price, upper(nullif(regexp_extract(html, '"priceCurrency":"(.*?)"', 1), '')) AS ld_currency,
  replace(nullif(regexp_extract(html, '"product-price"><span class="price">([\d,]+) лв', 1), ''), ',', '.')::DOUBLE AS shown, replace(nullif(regexp_extract(html, '"old-price">([\d,]+) лв', 1), ''), ',', '.')::DOUBLE AS old,
  nullif(regexp_extract(html, 'view_item.*?"price": "([\d.]+)"', 1), '')::DOUBLE AS e_price, upper(nullif(regexp_extract(html, 'view_item.*?"currency":"(.*?)"', 1), '')) AS e_currency,
  CASE WHEN contains(html, '"availability":"https://schema.org/InStock"') THEN 'in_stock' END AS availability, nullif(regexp_extract(html, 'EAN: (\d{13})', 1), '') AS ean, nullif(regexp_extract(html, '"mpn":"(.*?)"', 1), '') AS manufacturer_code, nullif(regexp_extract(html, '"brand":\{"name":"(.*?)"', 1), '') AS brand FROM raw),
found AS (SELECT *, coalesce(ld_price, e_price, shown) AS price FROM read)
SELECT kind, page_id, title, price, old, CASE WHEN price < old THEN price END AS promo, CASE WHEN ld_price IS NOT NULL THEN ld_currency WHEN e_price IS NOT NULL THEN e_currency WHEN shown IS NOT NULL THEN 'BGN' END AS currency,
  CASE WHEN ld_price IS NOT NULL THEN 'json_ld' WHEN e_price IS NOT NULL THEN 'gtag_view_item' WHEN shown IS NOT NULL THEN '.product-price' END AS source, availability, ean, manufacturer_code, brand,
  CASE WHEN title IS NOT NULL AND ld_price IS NOT NULL THEN 'high' WHEN title IS NOT NULL AND price IS NOT NULL THEN 'medium' WHEN title IS NOT NULL OR price IS NOT NULL THEN 'low' ELSE 'none' END AS confidence FROM found""")
def src_html(d: Domain) -> DataFrame:
    """Fields of a shop's raw pages and of the given ones, which offer nothing for sale."""
    raw = d.shop_pages.select(F.lit("shop").alias("kind"), F.col("id").alias("page_id"), "url", "html").unionByName(d.pages.select(F.lit("given").alias("kind"), "page_id", "url", "html"))
    told = ("title", "price", "old", "promo", "currency", "source", "availability", "ean", "manufacturer_code", "brand", "confidence")
    return pages.observed_pages(raw).select("kind", "page_id", *(F.col(f"page.{c}").alias(c) for c in told))
