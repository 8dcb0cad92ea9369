"""Domain tables derived from the driver's star schema.

Each derivation is one SQL text in the dialect that Spark and DuckDB share, so
a query and its oracle start from the same rows. ``{name}`` stands for a table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tallymart.operators.latest import advance, latest_table
from tallymart.operators.text_search import TextIndex, scan, search, text_index
from tallymart.sources.scratch import kept, scratch

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark")

#: Derivations by table, in order of dependence.
DERIVED = {
    "products": """
SELECT p_partkey AS id, p_partkey % 40 AS import_batch_id,
       CASE WHEN p_partkey % 97 = 0 THEN 'SKU-' || CAST(p_partkey - 1 AS STRING) ELSE 'SKU-' || CAST(p_partkey AS STRING) END AS sku,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '59' || lpad(CAST(p_partkey * 7919 AS STRING), 11, '0') END AS ean,
       CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_brand END AS brand, p_name AS name,
       CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_type END AS category,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'MQ' || CAST(p_partkey AS STRING) || '-K' END AS manufacturer_code,
       CASE WHEN p_partkey % 5 = 0 THEN 'model' || CAST(p_partkey AS STRING) ELSE NULL END AS model,
       CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(floor(p_retailprice / 30 * 100) / 100.0E0 AS DECIMAL(14,4)) END AS own_price,
       CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size AS STRING) || ' GB' ELSE NULL END AS storage,
       CASE WHEN p_partkey % 4 = 1 THEN 'Red' ELSE NULL END AS color, CASE WHEN p_partkey % 5 = 2 THEN '8 GB' ELSE NULL END AS memory
FROM {part}""",
    "competitors": """
SELECT s.s_suppkey AS id, s.s_name AS name, 'shop' || CAST(s.s_suppkey AS STRING) || '.example.com' AS domain, n.n_name AS country,
       s.s_acctbal > 0 AS is_active
FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey""",
    "price_snapshots": """
SELECT l_partkey * 100000 + l_suppkey AS listing_id, l_partkey AS part_id, l_suppkey AS site_id,
       CAST(floor(l_extendedprice / l_quantity / 30 * 100) / 100.0E0 AS DECIMAL(14,4)) AS price,
       CASE WHEN l_tax > 0.06 THEN CAST(floor(l_extendedprice / l_quantity / 25 * 100) / 100.0E0 AS DECIMAL(14,4)) ELSE NULL END AS old_price,
       CASE WHEN l_discount > 0.05 THEN CAST(floor(l_extendedprice / l_quantity / 30 * (1 - l_discount) * 100) / 100.0E0 AS DECIMAL(14,4)) ELSE NULL END AS promo_price,
       CASE WHEN l_linestatus = 'O' THEN 'BGN' ELSE 'EUR' END AS currency,
       CASE WHEN l_returnflag = 'A' THEN 'in_stock' WHEN l_returnflag = 'R' THEN 'out_of_stock' ELSE NULL END AS availability,
       l_shipdate AS captured_at, l_orderkey AS order_id, l_linenumber AS line_no, l_extendedprice AS tie
FROM {lineitem}""",
    "listings": """
SELECT listing_id AS id, site_id AS competitor_id, CASE WHEN part_id % 31 = 0 THEN NULL ELSE site_id % 25 END AS category_id,
       CASE WHEN (part_id + site_id) % 5 = 0 THEN part_id ELSE NULL END AS product_id,
       'https://shop' || CAST(site_id AS STRING) || '.example.com/bg/item/' || CAST(part_id AS STRING) || '?utm_source=x' AS url,
       CASE WHEN part_id % 37 = 0 THEN NULL ELSE 'Listing ' || CAST(part_id AS STRING) || ' of shop ' || CAST(site_id AS STRING) END AS title,
       CASE WHEN part_id % 8 = 0 THEN NULL ELSE '59' || lpad(CAST(part_id * 7919 AS STRING), 11, '0') END AS ean,
       'C' || CAST(part_id AS STRING) AS sku,
       CASE WHEN part_id % 13 = 0 THEN NULL ELSE price END AS latest_price, old_price AS latest_old_price,
       CASE WHEN part_id % 13 = 0 THEN NULL ELSE promo_price END AS latest_promo_price,
       CASE WHEN part_id % 41 = 0 THEN '' ELSE currency END AS latest_currency, availability AS latest_availability,
       CASE WHEN part_id % 11 = 0 THEN NULL ELSE captured_at END AS latest_scraped_at,
       CASE WHEN part_id % 11 = 0 THEN NULL WHEN part_id % 10 < 2 THEN 'failed' ELSE 'success' END AS latest_scrape_status,
       CASE WHEN part_id % 10 = 0 THEN 'http_blocked' WHEN part_id % 10 = 1 THEN 'price_not_found' ELSE NULL END AS latest_scrape_error_code,
       captured_at AS last_seen_at, CASE WHEN site_id % 3 = 0 THEN NULL WHEN site_id % 3 = 1 THEN 'sitemap' ELSE 'feed' END AS discovery_source,
       part_id % 17 = 0 AS is_dead, part_id, first_at AS created_at
FROM (SELECT s.*, row_number() OVER (PARTITION BY part_id, site_id ORDER BY captured_at DESC, order_id DESC, line_no DESC, tie DESC) AS rn,
             min(captured_at) OVER (PARTITION BY part_id, site_id) AS first_at FROM {price_snapshots} s) x
WHERE rn = 1""",
    "offers": """
SELECT l.id, p.name || ' ' || p.category AS title, CASE WHEN l.part_id % 9 = 0 THEN NULL ELSE p.brand END AS brand,
       CASE WHEN l.part_id % 8 < 3 THEN l.ean ELSE NULL END AS ean, CASE WHEN l.part_id % 7 = 0 THEN p.manufacturer_code ELSE NULL END AS manufacturer_code,
       CASE WHEN l.part_id % 10 = 0 THEN p.model ELSE NULL END AS model, l.sku, p.storage AS spec_storage,
       CASE WHEN l.part_id % 8 = 1 THEN 'red' WHEN l.part_id % 8 = 5 THEN 'blue' ELSE NULL END AS spec_color, CASE WHEN l.part_id % 10 = 2 THEN '8' WHEN l.part_id % 10 = 7 THEN '16' ELSE NULL END AS spec_memory
FROM {listings} l JOIN {products} p ON p.id = l.part_id""",
    "matches": """
SELECT id AS listing_id, part_id AS product_id,
       CASE part_id * 3 % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'auto_matched' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'low_confidence' ELSE 'rejected' END AS status,
       CAST(50 + (part_id * 7 + competitor_id) % 50 AS DECIMAL(8,5)) AS match_score, 'ean_exact' AS match_method
FROM {listings} WHERE (part_id + competitor_id) % 5 <> 0
UNION ALL
SELECT id, part_id + 1, CASE part_id % 4 WHEN 0 THEN 'auto_matched' WHEN 1 THEN 'low_confidence' WHEN 2 THEN 'needs_review' ELSE 'rejected' END,
       CAST(40 + (part_id * 3 + competitor_id) % 60 AS DECIMAL(8,5)), 'title_similarity'
FROM {listings} WHERE part_id % 3 = 0""",
    "categories": """
SELECT r_regionkey AS id, CAST(NULL AS INT) AS parent_id, r_name AS name, 0 AS level FROM {region}
UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name, 1 FROM {nation}
UNION ALL SELECT DISTINCT 10000 + 100 * n_nationkey + ascii(c_mktsegment), 100 + n_nationkey, c_mktsegment, 2
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""",
    "outcomes": """
SELECT event_id, user_id AS listing_id, ts AS captured_at,
       CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN 'failed' ELSE 'scraped' END AS outcome,
       CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN
         CASE event_id % 5 WHEN 0 THEN 'playwright_timeout' WHEN 1 THEN 'playwright_timeout' WHEN 2 THEN 'product_not_found' WHEN 3 THEN 'price_not_found' ELSE 'network_error' END
       ELSE NULL END AS error_code,
       CAST(floor(value * 100) / 100.0E0 AS DECIMAL(14,4)) AS price, event_type AS layer
FROM {events}""",
    "import_batches": """
SELECT CAST(p_size AS BIGINT) AS id, 'catalog-' || CAST(p_size AS STRING) || '.xlsx' AS filename, CAST('1998-01-01 00:00:00' AS TIMESTAMP) AS created_at
FROM {part} GROUP BY p_size""",
    "cells": """
SELECT l_orderkey * 10 + l_linenumber AS k,
  CASE (l_partkey + l_linenumber) % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '59' || lpad(CAST(l_partkey * 7919 AS STRING), 11, '0') WHEN 3 THEN ' MQ-' || CAST(l_partkey AS STRING) || '/K.a_b ' WHEN 4 THEN 'n/a' WHEN 5 THEN CAST(l_partkey AS STRING) || '.0'
    WHEN 6 THEN ' - ' WHEN 7 THEN 'Цвят ' || CAST(l_suppkey AS STRING) || ' GB' WHEN 8 THEN CAST(l_suppkey AS STRING) || 'gb DDR4 ' || CAST(l_linenumber AS STRING) || 'TB' WHEN 9 THEN CAST(l_suppkey AS STRING) || ' GB RAM' ELSE 'AB ' || l_shipmode_like END AS code,
  CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Лаптоп Dell ' || CAST(l_suppkey AS STRING) || ' черен' WHEN 2 THEN 'Puzzle ' || CAST(l_partkey AS STRING) || ' части' WHEN 3 THEN 'часовник WATCH' WHEN 4 THEN 'крем ' || CAST(l_suppkey AS STRING) || ' мл' WHEN 5 THEN 'perfume ' || CAST(l_suppkey AS STRING) || '.5 l x' ELSE 'box of ' || CAST(l_partkey AS STRING) END AS title,
  CASE l_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN CAST(l_suppkey AS STRING) || ' 299,50 лв' WHEN 2 THEN CAST(l_suppkey AS STRING) || '.299,50' WHEN 3 THEN CAST(l_suppkey AS STRING) || ',299.50' WHEN 4 THEN CAST(l_suppkey AS STRING) || '.299' WHEN 5 THEN CAST(l_suppkey AS STRING) || ',9300' WHEN 6 THEN 'abc' ELSE CAST(l_partkey AS STRING) || ',5' END AS amount,
  CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'лв.' WHEN 2 THEN 'лв' WHEN 3 THEN '€' WHEN 4 THEN 'EUR' WHEN 5 THEN ' usd ' WHEN 6 THEN 'chf' WHEN 7 THEN 'kron' ELSE '' END AS currency,
  CASE l_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'https://www.Shop' || CAST(l_suppkey AS STRING) || '.bg/bg/x/p/' || CAST(l_partkey AS STRING) || '?utm_source=a&color=red&page=2' WHEN 2 THEN 'http://m.shop.bg:80/a/' || CAST(l_partkey AS STRING) || '/?ref=x#top' WHEN 3 THEN 'shop.bg/path' || CAST(l_suppkey AS STRING) WHEN 4 THEN ''
    WHEN 5 THEN 'https://shop.bg/' || CAST(l_partkey AS STRING) || '.css' WHEN 6 THEN 'https://shop.bg/en/item-' || CAST(l_partkey AS STRING) || '/' WHEN 7 THEN 'ftp://shop.bg/x' WHEN 8 THEN 'https://shop.bg/sitemap_index.xml?x=' || CAST(l_suppkey AS STRING) ELSE 'https://shop.bg/bg/laptops/item-' || CAST(l_partkey AS STRING) || '?p=3&q=' || CAST(l_suppkey AS STRING) || '&fbclid=9&v=' END AS url,
  CASE l_partkey % 11 WHEN 0 THEN 'price_missing' WHEN 1 THEN 'got status_404 at ' || CAST(l_suppkey AS STRING) WHEN 2 THEN 'Too Many Requests' WHEN 3 THEN 'http_parse broke' WHEN 4 THEN 'http_blocked' WHEN 5 THEN 'Timeout 30000ms' WHEN 6 THEN 'connection reset' WHEN 7 THEN 'playwright crashed' WHEN 8 THEN NULL WHEN 9 THEN 'status_403: x;blocked_challenge: y' ELSE 'status_429: a;status_401: b' END AS message,
  CASE l_suppkey % 6 WHEN 0 THEN 'In stock now' WHEN 1 THEN 'out of stock' WHEN 2 THEN 'preorder' WHEN 3 THEN 'няма наличност' WHEN 4 THEN '???' ELSE NULL END AS stock_text,
  CASE l_suppkey % 5 WHEN 0 THEN 'inStock' WHEN 1 THEN 'outOfStock' WHEN 2 THEN 'lowStock' WHEN 3 THEN 'Weird' ELSE NULL END AS stock_code,
  l_suppkey AS n1, l_partkey AS n2, l_linenumber AS n3, l_quantity AS q, l_extendedprice AS price, l_shipdate AS at
FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'x-Y' ELSE 'Z_9' END AS l_shipmode_like FROM {lineitem}) s""",
    "links": """
SELECT p_partkey AS id, site, channel, CASE p_partkey % 29
  WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'https://' || site || '/' WHEN 3 THEN 'https://www.' || site || '/bg/p/' || CAST(p_partkey AS STRING) || '?utm_source=a'
  WHEN 4 THEN 'https://' || site || '/brand/' || word || '-product-1000' WHEN 5 THEN 'https://' || site || '/' || slug || '-' || CAST(p_size AS STRING) || 'ml'
  WHEN 6 THEN 'https://' || site || '/' || slug || '.jpg' WHEN 7 THEN 'https://' || site || '/obschi-uslovija-' || slug || '-12-2025' WHEN 8 THEN 'https://' || site || '/c/' || word || '?sku=' || CAST(p_partkey AS STRING) || '&page=2'
  WHEN 9 THEN 'https://' || site || '/bg/home/' || slug || '-for-the-whole-family' WHEN 10 THEN 'https://' || site || '/bg/home/' || slug || '-for-the-whole-family?a=1' WHEN 11 THEN 'https://' || site || '/oferti/' || slug || '-x1'
  WHEN 12 THEN 'https://' || site || '/items/' || word || '-red-blue' WHEN 13 THEN 'https://' || site || '/items/' || word WHEN 14 THEN 'https://' || site || '/cats/pazeli-nad-3-godini' WHEN 15 THEN 'https://other.example/p/' || CAST(p_partkey + 1000 AS STRING)
  WHEN 16 THEN 'https://' || site || '/en/deep/' || word || '-box-' || CAST(p_partkey + 100 AS STRING) WHEN 17 THEN 'https://' || site || '/brands/' || word WHEN 18 THEN 'https://' || site || '/search?q=' || word WHEN 19 THEN 'HTTPS://' || upper(site) || '/Products/' || CAST(p_partkey + 100 AS STRING) || '/#top'
  WHEN 20 THEN 'https://' || site || '/sale/summer-black-friday' WHEN 21 THEN 'https://' || site || '/продукти/' || word || '-' || CAST(p_size AS STRING) || '-цвят-червен' WHEN 22 THEN site || '/p/' || CAST(p_partkey + 100 AS STRING) WHEN 23 THEN 'https://' || site || '/p/' || word || '-brand'
  WHEN 24 THEN 'https://' || site || '/a/b/productsegment_' || word || '-x-1234' WHEN 25 THEN 'https://' || site || '/sbf-' || word || '-sets-20' WHEN 26 THEN 'https://' || site || '/offer/promo-' || CAST(p_partkey + 100 AS STRING) WHEN 27 THEN 'https://' || site || '/store/x;v=1?pid='
  ELSE 'https://' || site || '/product/' || CAST(p_partkey % 500 + 500 AS STRING) END AS url
FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN 'big.bg' ELSE 'shop' || CAST(p_size % 4 AS STRING) || '.bg' END AS site,
             CASE p_size % 5 WHEN 0 THEN 'external' WHEN 1 THEN 'dynamic' WHEN 2 THEN NULL ELSE 'sitemap' END AS channel, lower(replace(p_name, ' ', '-')) AS slug, lower(split_part(p_name, ' ', 1)) AS word FROM {part}) s""",
    "shop_pages": """
SELECT p_partkey AS id, 'https://shop.example/bg/p/' || CAST(p_partkey AS STRING) AS url,
  '<html><head><title>' || p_name || ' | Shop</title>' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '<meta property="og:title" content="' || p_name || '">' END
  || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '<script type="application/ld+json">{{"@type":"Product","name":"' || p_name || '","mpn":"M' || CAST(p_partkey AS STRING) || '","brand":{{"name":"' || p_brand || '"}},"offers":{{"price":"' || CAST(p_partkey AS STRING) || '.50","priceCurrency":"bgn","availability":"https://schema.org/InStock"}}}}</script>' END
  || '</head><body><nav class="breadcrumb"><a href="/">Home</a><a href="/c/1">' || p_type || '</a><a href="#">' || p_name || '</a></nav><h1>' || p_name || '</h1><div class="related"><span class="price">1,00 лв.</span></div>'
  || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '<div class="product-price"><span class="price">' || CAST(p_partkey AS STRING) || ',90 лв.</span><span class="old-price">' || CAST(p_partkey + 10 AS STRING) || ',00 лв.</span></div>' END
  || '<table><tr><th>Цвят:</th><td>red ' || CAST(p_size AS STRING) || '</td></tr><tr><th>Марка</th><td>' || p_brand || '</td></tr><tr><th>друго</th><td>z</td></tr></table><img src="/i/' || CAST(p_partkey AS STRING) || '.jpg"><a href="/bg/p/' || CAST(p_partkey + 1 AS STRING) || '?utm_source=q">next item</a><a rel="next" href="/c/1?page=2">2</a>Sold by: Shop ' || CAST(p_size AS STRING) || '<br>EAN: 5901234123457'
  || CASE WHEN p_partkey % 6 = 0 THEN '<script>gtag("event","view_item",{{items:[{{"price": "' || CAST(p_partkey AS STRING) || '.10","currency":"EUR"}}]}})</script>' ELSE '' END || '</body></html>' AS html
FROM {part}""",
    "product_pages": """
SELECT p_partkey AS id, 'https://shop.example/bg/p/' || CAST(p_partkey AS STRING) || '/' AS url,
  CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 43 = 0 THEN ''
  WHEN p_partkey % 10 = 9 THEN '<html><body><h1>' || p_name || '</h1><p>Цена ' || CAST(p_size + 25 AS STRING) || ',50 лв. преди <b>' || CAST(p_size + 90 AS STRING) || ',00 лв.</b></body></html>' ELSE
  '<!DOCTYPE html><html><head><title>' || p_name || ' | Shop</title>' || CASE p_partkey % 9
    WHEN 0 THEN '<script type="application/ld+json">{{"@type":"Product","name":" ' || p_name || '","mpn":"M' || CAST(p_partkey AS STRING) || '","gtin8":"5901234123457","image":["https://cdn.example/a.jpg"],"brand":{{"name":"' || p_brand || '"}},"offers":{{"price":' || CAST(p_partkey AS STRING) || '.50,"priceCurrency":"bgn","availability":"https://schema.org/InStock"}}}}</script>'
    WHEN 1 THEN '<script type=' || chr(39) || 'application/ld+json' || chr(39) || '>{{"@graph":[{{"@type":"WebPage","mainEntity":{{"@type":"BreadcrumbList","name":"no"}}}},{{"@type":["Thing","Product"],"name":"' || p_name || ' X","brand":"' || p_brand || '","sku":' || CAST(p_partkey AS STRING) || ',"offers":[{{"price":"' || CAST(p_size AS STRING) || ',75","priceCurrency":"EUR","availability":"SoldOut"}},{{"price":1}}]}}]}}</script>'
    WHEN 2 THEN '<script type="application/ld+json">{{broken</script><script type="application/ld+json">[{{"@type":"WebPage"}},{{"@type":"WebPage","mainEntity":{{"@type":"ProductGroup","name":{{"name":"' || p_name || ' G"}},"brand":[{{"name":"' || p_brand || '"}}],"image":{{"url":"/g.jpg"}},"offers":{{"price":[0,3],"lowPrice":["' || CAST(p_size + 7 AS STRING) || '.2"],"priceCurrency":["eur"],"availability":"http://schema.org/PreOrder"}}}}}}]</script>'
    WHEN 5 THEN '<meta property="product:price:amount" content="' || CAST(p_size AS STRING) || '.99"><meta property="og:title" content="' || p_name || ' M">'
    WHEN 7 THEN '<script type="application/ld+json">{{"@type":"ItemList","itemListElement":[{{"@type":"ListItem","position":1}}]}}</script>' ELSE '' END
  || '</head><body><nav class="breadcrumb"><ul><li><a href="/">Home</a><li><a href="/c/1">' || p_type || '</a><li><a href="#">' || p_name || '</a></ul></nav><h1>' || p_name || ' <small>&amp; co</small></h1>'
  || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '<div class="related-items"><div class="card"><div><span class="price">1,00 лв.</span></div></div><div class="price">0,99 €</div></div><!--/noise--><a href="/bg/p/other"><span class="price">2,00 лв.</span></a><!--/noise-->' END
  || CASE p_partkey % 9
    WHEN 0 THEN '<div class="main"><b class="price">' || CAST(p_partkey AS STRING) || ',90 лв.</b><del>' || CAST(p_partkey + 10 AS STRING) || ',00 лв.</del></div>'
    WHEN 3 THEN '<div id=p><p>Now<span class=' || chr(39) || 'price' || chr(39) || '>' || CAST(p_size AS STRING) || ',50 €</span><p class="old-price">' || CAST(p_size + 20 AS STRING) || ',00 €<div>In stock</div></div>'
    WHEN 4 THEN '<div class="price">9,90 лв.</div><script>gtag("event","view_item",{{items:[{{"price": "' || CAST(p_size AS STRING) || '.10"' || CASE WHEN p_size % 2 = 0 THEN ',"currency":"eur"' ELSE '' END || '}}]}})</script>'
    WHEN 6 THEN '<div class="buy" data-price="' || CAST(p_size + 1 AS STRING) || '.25 EUR"></div><span class="price">77,00 лв.</span><p>EAN: 5901234123457<p>Модел: AB-' || CAST(p_partkey AS STRING)
    WHEN 8 THEN '<div class="price">5,00 лв.</div><div class="swatch-attribute size"><div class="swatch-attribute-options"><div class="opt"><i>10 ml</i> 1,00 €</div><div class="opt selected"><b>50 мл</b> ' || CAST(p_size + 5 AS STRING) || ',90 € <s>' || CAST(p_size AS STRING) || ',50 €</s></div></div></div>'
    ELSE '' END
  || '<table><tr><th>Цвят:</th><td>red <b>' || CAST(p_size AS STRING) || '</b></td></tr><tr><td>друго<td>z</table><dl><dt>Марка<dd>' || p_brand || '</dl><ul class="specification-list"><li>RAM: ' || CAST(p_size AS STRING) || ' GB<li><b>Модел</b> m' || CAST(p_size AS STRING) || '</ul><img class="product-image" src="i/' || CAST(p_partkey AS STRING) || '.jpg"></body></html>' END AS html
FROM {part}""",
    "variant_pages": """
SELECT p_partkey AS id, 'https://shop.example/cream/p-' || CAST(p_partkey AS STRING) || '/' AS url,
  '<html><script>var s = {{"list":[{{"x":"a }} b","url":"/cream/p-' || CAST(p_partkey AS STRING) || '/","name":"' || p_brand || '","additionalInfo":"цвят F' || CAST(p_size AS STRING) || ' 30 мл.","productCode":"M' || CAST(p_partkey AS STRING) || '","__typename":"CatalogVariant","price":{{"value":' || CAST(p_size + 20 AS STRING) || ',"currency":"bgn"}},"originalPrice":{{"value":' || CAST(p_size + 30 AS STRING) || ',"type":"' || CASE WHEN p_partkey % 2 = 0 THEN 'Recommended' ELSE 'Lowest' END || '"}}}},'
  || '{{"url":"/cream/p-0/","colors":["red"],"parameters":{{"amount":50,"unit":"ml"}},"q":1,"__typename":"CatalogVariant"}},{{"url":"/cream/p-9/","__typename":"CatalogVariant","eanCode":"5901234123457","price":{{"value":' || CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE CAST(p_size AS STRING) END || '}},"colors":["red"]}},'
  || '{{"url":"/cream/p-9/","__typename":"CatalogVariant"}},{{"url":"/broken/"[,"__typename":"CatalogVariant"}}]}};</script><div class="swatch-attribute size"><label class="product-option-label"><span x-text="v">75 мл</span></label><div class="swatch-attribute-options"><div class="opt">10 ml 1,00 €</div>'
  || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '<div class="opt Selected">50 мл ' || CAST(p_size + 5 AS STRING) || ',90 € ' || CAST(p_size AS STRING) || ',50 €</div>' ELSE '<div class="opt active"><b>100 ml</b> € ' || CAST(p_size AS STRING) || '.40</div>' END || '</div></div></html>' AS html
FROM {part}""",
    "feed_items": """
SELECT p_partkey AS id, '{{"sku":"P' || CAST(p_partkey % 500 AS STRING) || '","name":"' || p_brand || ' cream","url_key":"u' || CAST(p_partkey AS STRING) || '","price":' || CASE WHEN p_partkey % 7 = 0 THEN 'null' ELSE CAST(p_size AS STRING) END || ',"barcodes":"' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN ', 2"' ELSE '"' END
  || CASE WHEN p_partkey % 3 = 0 THEN ',"variants":[{{"sku":"a' || CAST(p_partkey AS STRING) || '","price":1}},{{"sku":"b' || CAST(p_partkey AS STRING) || '","price":2}}]}}' ELSE '}}' END AS item
FROM {part}""",
    "sitemaps": """
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://a/' || CAST(p_partkey AS STRING) || ' </loc></url><url><loc>http://a/2</loc></url></urlset>'
  WHEN 1 THEN '<sitemapindex><sitemap><loc>/s' || CAST(p_partkey AS STRING) || '.xml</loc></sitemap></sitemapindex>' WHEN 2 THEN 'http://a/p' || CAST(p_partkey AS STRING) || chr(10) || '# note' || chr(10) || 'http://a/q'
  WHEN 3 THEN '<rss><channel><item><link>http://a/r' || CAST(p_partkey AS STRING) || '</link></item></channel></rss>' ELSE NULL END AS body
FROM {part}""",
    "sitemap_files": """
SELECT 'https://shop.example/sitemap-' || CAST(p_partkey AS STRING) || '.xml' AS url, CASE p_partkey % 6
  WHEN 0 THEN NULL
  WHEN 1 THEN '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://shop.example/sitemap-' || CAST(p_partkey * 2 AS STRING) || '.xml</loc></sitemap><sitemap><loc>https://shop.example/sitemap-' || CAST(p_partkey * 2 + 1 AS STRING) || '.xml</loc></sitemap><sitemap><loc>https://shop.example/sitemap-1.xml</loc></sitemap></sitemapindex>'
  WHEN 2 THEN '<urlset><url><loc>https://shop.example/p/' || CAST(p_partkey AS STRING) || '?a=1&amp;b=2</loc></url><url><loc>https://shop.example/sitemap-' || CAST(p_partkey * 2 AS STRING) || '.xml</loc></url><url><loc>https://shop.example/sitemap-' || CAST(p_partkey * 2 + 1 AS STRING) || '.xml</loc></url></urlset>'
  WHEN 3 THEN 'https://shop.example/p/' || CAST(p_partkey AS STRING) || chr(10) || '# note' || chr(10) || 'https://shop.example/sitemap-' || CAST(p_partkey * 2 AS STRING) || '.xml' || chr(10) || 'https://shop.example/sitemap-' || CAST(p_partkey * 2 + 1 AS STRING) || '.xml'
  WHEN 4 THEN '<rss><channel><link>https://shop.example/</link><item><title>x</title><link>https://shop.example/r/' || CAST(p_partkey AS STRING) || '</link></item></channel></rss>'
  ELSE '<urlset><url><loc>https://shop.example/p/' || CAST(p_partkey AS STRING) || '</loc></url></urlset>' END AS body
FROM {part}""",
    "import_rows": """
SELECT CAST(c_custkey % 7 AS INT) AS batch_id, c_custkey AS row_no,
       CASE WHEN c_custkey % 9 = 0 THEN '-' WHEN c_custkey % 10 = 0 THEN NULL ELSE ' 59' || lpad(CAST(c_custkey * 31 AS STRING), 11, '0') || ' ' END AS ean,
       CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE 'MC-' || CAST(c_custkey AS STRING) END AS manufacturer_code,
       CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE c_name END AS name,
       CASE WHEN c_custkey % 17 = 0 THEN 'abc' WHEN c_custkey % 5 = 0 THEN '12,50' ELSE '99.9' END AS own_price,
       CASE WHEN c_custkey % 2 = 0 THEN 'SKU-' || CAST(c_custkey % 300 AS STRING) ELSE NULL END AS sku,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE ' ' || c_mktsegment END AS brand, CASE WHEN c_custkey % 3 = 0 THEN 'Red' ELSE NULL END AS color, CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey AS STRING) || '.0' ELSE NULL END AS model
FROM {customer}""",
}


#: Derived tables that are written once for a data folder, as they stand on windows or joins; queries then read them like any table.
WRITTEN = ("listings", "matches", "offers")


#: Text columns that searches look into.
INDEXED = {"products": ("sku", "name", "ean", "brand"), "listings": ("title", "url", "sku")}

_domains: dict[tuple[str, str], Domain] = {}


def domain(spark: SparkSession, sf_dir: str) -> Domain:
    """The domain of a data folder, one for each application, so that its written tables are shared by all queries."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _domains or _domains[key].spark is not spark:
        _domains[key] = Domain(spark, sf_dir, write=True)
    return _domains[key]


class Domain:
    """Domain tables of one data folder, made on first use; ``write``: those of ``WRITTEN`` as Parquet in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, write: bool = False) -> None:
        self.spark, self.sf_dir, self.write = spark, sf_dir, write
        self._made: dict[str, DataFrame] = {}
        self._indexes: dict[tuple[str, tuple[str, ...]], TextIndex] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in DERIVED:
                text = DERIVED[name]
                needed = {t: getattr(self, t) for t in (*BASE, *DERIVED) if "{" + t + "}" in text}
                found = self.spark.sql(text, **needed)
                if self.write and name in WRITTEN:
                    found = kept(found, name)
                self._made[name] = found
            else:
                raise AttributeError(name)
        return self._made[name]

    @cached_property
    def latest_prices(self) -> DataFrame:
        """The latest snapshot of each listing, from a kept table that is brought up to date on first use."""
        table = latest_table(self.price_snapshots, f"{scratch(self.spark)}/latest")
        advance(table, self.price_snapshots)
        return table.read()

    def prepare(self) -> None:
        """Write what queries share: the tables of ``WRITTEN``, the latest prices and the posting indexes."""
        for name in WRITTEN:
            getattr(self, name)
        _ = self.latest_prices
        for table, columns in INDEXED.items():
            self.index(table, columns)

    def index(self, table: str, columns: tuple[str, ...]) -> TextIndex:
        """The posting index of some text columns of a table, written on first use."""
        if (table, columns) not in self._indexes:
            self._indexes[table, columns] = text_index(getattr(self, table), "id", columns, f"{scratch(self.spark)}/index-{table}")
        return self._indexes[table, columns]

    def search(self, table: str, text: str, columns: tuple[str, ...] | None = None) -> DataFrame:
        """The ids of the rows of which a text column contains ``text``: by the table's posting index where it has been written, else by reading the texts.

        One search never pays for an index, which takes several times the
        texts' disk to make; :meth:`prepare` writes the indexes for many.
        """
        indexed = INDEXED[table]
        if (table, indexed) in self._indexes:
            return search(self._indexes[table, indexed], text, columns)
        return scan(getattr(self, table), "id", columns or indexed, text)

    @cached_property
    def as_of(self) -> str:
        """The fixed instant that stands for now."""
        return AS_OF


#: The instant that freshness is measured against.
AS_OF = "1998-12-01 00:00:00"


def oracle(text: str) -> str:
    """DuckDB SQL: ``text`` over the base tables and those derived tables that it names."""
    names = {t: t for t in (*BASE, *DERIVED)}
    needed: list[str] = []

    def need(t: str) -> None:
        if t not in needed:
            for other in DERIVED:
                if "{" + other + "}" in DERIVED[t]:
                    need(other)
            needed.append(t)

    for t in DERIVED:
        if _names(text, t):
            need(t)
    parts = [f"{t} AS ({DERIVED[t].format(**names)})" for t in DERIVED if t in needed]
    if not parts:
        return text
    body = text.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"


def _names(sql: str, table: str) -> bool:
    import re

    return re.search(rf"\b{table}\b", sql) is not None
