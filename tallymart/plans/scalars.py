"""Queries over scalar functions, each on columns or a table of literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions import codes, fields, money, urls
from tallymart.operators.ranking import first_of
from tallymart.plans.registry import query
from tallymart.sources.adapters import Domain


def scalar(name: str, column: str, f, sql: str) -> None:
    """A query (k, y) of ``f`` over a column of the messy cells of a table, and its SQL over ``x``."""
    query(name, f"SELECT k, {sql} AS y FROM (SELECT k, {column} AS x FROM cells)")(lambda d: d.cells.select("k", F.expr(column).alias("x")).select("k", f(F.col("x")).alias("y")))


_VOID = "('', '-', '--', '—', '–', '.', 'n/a', 'na', 'none', 'null', 'x')"
scalar("sc_norm", "code", codes.norm, "lower(trim(coalesce(x, '')))")
scalar("sc_norm_code", "code", codes.norm_code, "regexp_replace(lower(trim(coalesce(x, ''))), '[\\s\\-_./]', '', 'g')")
scalar("sc_norm_ean", "code", codes.norm_ean, "CASE WHEN length(regexp_replace(x, '[^0-9]', '', 'g')) >= 8 THEN regexp_replace(x, '[^0-9]', '', 'g') END")
scalar("sc_norm_ean_spec", "coalesce(code, '') || ' ' || CAST(n2 AS STRING)", codes.spec_ean, "CASE WHEN length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 14 THEN regexp_replace(x, '[^0-9]', '', 'g') END")
scalar("sc_placeholder", "code", codes.placeholder, f"CASE WHEN lower(trim(x)) IN {_VOID} THEN NULL ELSE trim(x) END")
scalar("sc_header_norm", "' Own  ' || code", codes.header_name, "regexp_replace(lower(trim(coalesce(x, ''))), '\\s+', '_', 'g')")
scalar("sc_cell_code", "code", codes.cell_code, f"CASE WHEN lower(trim(regexp_replace(x, '^(\\d+)\\.0+$', '\\1'))) IN {_VOID} THEN NULL ELSE trim(regexp_replace(x, '^(\\d+)\\.0+$', '\\1')) END")
scalar("sc_storage", "code", codes.storage_size, "coalesce(nullif(regexp_extract(lower(x), '(\\d+)\\s*gb', 1), ''), nullif(regexp_extract(lower(x), '(\\d+)\\s*tb', 1), ''))")
scalar("sc_memory", "code", codes.memory_size, "coalesce(nullif(regexp_extract(lower(x), '(\\d+)\\s*gb\\s*ram', 1), ''), nullif(regexp_extract(lower(x), '(\\d+)\\s*gb\\s*ddr', 1), ''))")
scalar("sc_extract_attr", "code", lambda x: codes.first_group(x, r"(?i)([a-z]+)[-_ ]?(\d+)"), "nullif(regexp_extract(x, '(?i)([a-z]+)[-_ ]?(\\d+)', 1), '')")
_DIGIT = "substr(reverse(x), i + 1, 1)"
scalar("sc_gtin_valid", "code", codes.gtin_valid, f"coalesce(regexp_matches(x, '^(\\d{{8}}|\\d{{12,14}})$') AND len(list_distinct(string_split(x, ''))) > 1 AND list_sum(list_transform(range(0, length(x)), lambda i: coalesce(try_cast({_DIGIT} AS INT), 0) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10 = 0, false)")

_joined = lambda c: F.array_join(F.array_sort(c), ",")
scalar("sc_tokens", "title", lambda x: _joined(codes.search_tokens(x)), "array_to_string(list_sort(list_distinct(regexp_extract_all(lower(trim(coalesce(x, ''))), '[a-z0-9а-я]{3,}'))), ',')")
scalar("sc_type_tokens", "title", lambda x: _joined(codes.type_tokens(x)), "array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(trim(coalesce(x, ''))), '[a-zа-я]+')), lambda t: t IN ('лаптоп', 'puzzle', 'часовник', 'watch', 'крем'))), ',')")
scalar("set_type_overlap", "title", lambda x: F.arrays_overlap(codes.type_tokens(x), F.array(F.lit("watch"), F.lit("лаптоп"))), "len(list_filter(regexp_extract_all(lower(coalesce(x, '')), '[a-zа-я]+'), lambda t: t IN ('watch', 'лаптоп'))) > 0")
scalar("sc_size", "title", codes.size_text, "nullif(replace(replace(upper(regexp_replace(regexp_extract(x, '(\\d+(?:\\.\\d+)?\\s*(?:мл|l))', 1), '\\s', '', 'g')), 'МЛ', 'ML'), 'Л', 'L'), '')")
scalar("sc_variant_color", "CASE WHEN n1 % 3 = 0 THEN 'цвят F' ELSE 'Color: red ' END || CAST(n1 AS STRING) || ' ' || CAST(n3 AS STRING) || ' мл'", codes.variant_color, "trim(regexp_replace(regexp_replace(x, '\\d+\\s*мл', ''), '^(цвят|Color:)\\s*', ''))")
scalar("sc_category_name", "title || '  ' || chr(9) || code", codes.category_name, "nullif(left(trim(regexp_replace(x, '\\s+', ' ', 'g')), 512), '')")
scalar("sc_strip_html", "'<p class=\"a\">' || title || '</p> <b>' || code || '</b>&amp;'", codes.strip_html, "trim(regexp_replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))")

_T = "regexp_replace(regexp_extract(x, '(\\d[\\d\\s.,]*)', 1), '\\s+', '', 'g')"
_W, _FR = (f"regexp_extract({_T}, '^(.*)[.,](\\d*)$', {k})" for k in (1, 2))
_MIXED = f"(contains({_T}, ',') AND contains({_T}, '.'))"
_DECIMAL = f"CASE WHEN {_T} = '' THEN NULL WHEN NOT regexp_matches({_T}, '[.,]') THEN {_T}::DOUBLE WHEN {_MIXED} OR length({_FR}) <> 3 THEN (regexp_replace({_W}, '[.,]', '', 'g') || '.' || {_FR})::DOUBLE ELSE regexp_replace({_T}, '[.,]', '', 'g')::DOUBLE END"
scalar("sc_parse_decimal", "amount", lambda x: money.parse_decimal(x).cast("double"), _DECIMAL)
_L = "regexp_replace(x, '\\s+', '', 'g')"
scalar("sc_parse_leva", "amount", lambda x: money.parse_leva(x).cast("double"), f"CASE WHEN NOT regexp_matches({_L}, '^[\\d.,]+$') THEN NULL WHEN (contains({_L}, ',') AND contains({_L}, '.')) OR (length(regexp_replace({_L}, '[^.,]', '', 'g')) = 1 AND length(regexp_extract({_L}, '[.,](\\d*)$', 1)) BETWEEN 1 AND 2) THEN (regexp_replace(regexp_extract({_L}, '^(.*)[.,]', 1), '[.,]', '', 'g') || '.' || regexp_extract({_L}, '[.,](\\d*)$', 1))::DOUBLE ELSE regexp_replace({_L}, '[.,]', '', 'g')::DOUBLE END")
scalar("sc_extract_leva", "'цена ' || CAST(n1 AS STRING) || ',90 лв. стара ' || CAST(n2 AS STRING) || ',50 лв.'", lambda x: F.array_join(F.transform(money.leva_amounts(x), lambda v: v.cast("decimal(14,2)").cast("string")), ";"), "array_to_string(list_transform(regexp_extract_all(x, '(\\d+,\\d+) лв', 1), lambda v: replace(v, ',', '.')), ';')")
scalar("sc_price_candidates", "'от ' || CAST(n1 AS STRING) || ',90 лв. до ' || CAST(n2 AS STRING) || '.50 EUR или 0 лв'", lambda x: F.array_join(F.transform(money.price_candidates(x), lambda c: F.concat_ws(" ", c["amount"].cast("decimal(14,2)").cast("string"), c["currency"])), ";"), "replace(regexp_extract(x, '(\\d+,\\d+) лв', 1), ',', '.') || ' BGN;' || regexp_extract(x, '(\\d+\\.\\d+) EUR', 1) || ' EUR'")
_SANE = "list_sort(list_distinct(list_filter(list_transform(string_split(x, ','), lambda v: v::DOUBLE), lambda v: v BETWEEN 0.01 AND 999999.99)))"
scalar("sc_pick_prices", "CAST(n1 AS STRING) || ',' || CAST(n2 AS STRING) || ',0,' || CAST(n3 AS STRING)", lambda x: F.transform(F.array(*(money.likely_prices(F.transform(F.split(x, ","), lambda v: v.try_cast("decimal(18,4)")))[k] for k in ("price", "old", "promo"))), lambda v: F.coalesce(v.cast("decimal(18,2)").cast("string"), F.lit("-"))).cast("string"), f"'[' || format('{{:.2f}}', {_SANE}[1]) || ', ' || CASE WHEN len({_SANE}) > 1 THEN format('{{:.2f}}', {_SANE}[-1]) || ', ' || format('{{:.2f}}', {_SANE}[1]) ELSE '-, -' END || ']'")
scalar("sc_currency", "currency", money.currency_code, "CASE replace(lower(trim(x)), '.', '') WHEN 'лв' THEN 'BGN' WHEN '€' THEN 'EUR' ELSE CASE WHEN length(replace(trim(x), '.', '')) = 3 THEN upper(replace(trim(x), '.', '')) END END")
scalar("sc_currency_pref", "upper(trim(currency))", lambda x: money.currency_satisfies(x, F.lit("EUR")), "coalesce(x IN ('BGN', 'EUR'), false)")
scalar("sc_bgn_to_eur", "CAST(price AS DECIMAL(14,4))", lambda x: money.bgn_to_eur(x).cast("double"), "round(x::DECIMAL(18,4) / 1.95583, 2)::DOUBLE")
scalar("sc_normalise_eur", "CASE WHEN n1 % 2 = 0 THEN 'BGN' ELSE 'EUR' END || ' ' || CAST(n2 AS STRING)", lambda x: money.in_euro(F.split(x, " ")[1].cast("decimal(14,4)"), F.split(x, " ")[0]).cast("double"), "CASE WHEN x LIKE 'BGN %' THEN round(substr(x, 5)::DOUBLE / 1.95583, 2) ELSE substr(x, 5)::DOUBLE END")
scalar("sc_sane_price", "price * n1 * n2 * n3", lambda x: money.sane_price(x.cast("double")), "CASE WHEN abs(x::DOUBLE) < 1e10 THEN x::DOUBLE END")
scalar("sc_price_pct", "CAST(n2 AS DECIMAL(14,4))", lambda x: money.campaign_price(x, F.lit(20)).cast("double"), "round(x::DOUBLE * 0.8, 2)")
scalar("sc_regular_final", "CAST(n1 AS STRING) || '/' || CAST(n3 AS STRING)", lambda x: F.to_json(money.regular_final(F.split(x, "/")[0].cast("int"), F.split(x, "/")[1].cast("int"))), "CASE WHEN split_part(x, '/', 2)::INT < split_part(x, '/', 1)::INT THEN '{\"price\":' || split_part(x, '/', 1) || ',\"old\":' || split_part(x, '/', 1) || ',\"promo\":' || split_part(x, '/', 2) || '}' ELSE '{\"price\":' || split_part(x, '/', 1) || '}' END")
scalar("sc_promo_logic", "CAST(n1 AS STRING) || '/' || CASE WHEN n3 > 3 THEN CAST(n2 AS STRING) ELSE '' END", lambda x: money.promo_of(F.split(x, "/")[0].try_cast("int"), F.split(x, "/")[1].try_cast("int")), "CASE WHEN try_cast(split_part(x, '/', 2) AS INT) > split_part(x, '/', 1)::INT THEN split_part(x, '/', 1)::INT END")
scalar("sc_variant_price", "CAST(n3 AS STRING) || '/' || CAST(n1 AS STRING)", lambda x: F.to_json(money.variant_price(F.split(x, "/")[0].cast("int"), F.split(x, "/")[1].cast("int"))), "CASE WHEN split_part(x, '/', 1)::INT < split_part(x, '/', 2)::INT THEN '{\"price\":' || split_part(x, '/', 2) || ',\"old\":' || split_part(x, '/', 2) || ',\"promo\":' || split_part(x, '/', 1) || '}' ELSE '{\"price\":' || split_part(x, '/', 1) || '}' END")

_REST = "regexp_replace(trim(coalesce(x, '')), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '')"
_HOST = f"regexp_replace(lower(regexp_replace(regexp_extract({_REST}, '^([^/?#]*)', 1), ':\\d*$', '')), '^www\\.', '')"
_PATH = "regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(x, '\\?([^#]*)', 1)"


def _kept(query: str, names: str) -> str:
    return f"array_to_string(list_filter(string_split({query}, '&'), lambda p: regexp_matches(p, '=.') AND NOT regexp_matches(lower(p), '^(utm_|mc_|({names})=)')), '&')"


_TRACKING = "fbclid|gclid|ref|source|campaign|affiliate"
_STATE = _TRACKING + "|page|p|per_page|limit|offset|start|sort|sort_by|sortby|orderby|order|dir|view"
_SHORT = f"rtrim({_PATH}, '/')"
_KEPT = _kept(_QUERY, _STATE)
_DEDUPE = f"{_SHORT} || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END"
scalar("sc_domain", "url", urls.domain, _HOST)
scalar("sc_norm_url", "url", urls.full_url, "CASE WHEN x IS NULL THEN '' WHEN x = '' OR contains(x, '://') THEN x ELSE 'https://' || x END")
scalar("sc_generic_product_url", "url", urls.product_url, f"CASE WHEN regexp_matches(x, '^https?://[^/?#]') AND NOT regexp_matches({_SHORT}, '(?i)\\.(css|xml)$') THEN lower(regexp_extract(x, '^(https?://[^/?#]*)', 1)) || {_DEDUPE} END")
scalar("sc_strip_query", "substring(url, instr(url, '?') + 1)", urls.strip_query, _kept("x", _STATE))
scalar("sc_tech_query", "substring(url, instr(url, '?') + 1)", urls.strip_tracking, _kept("x", _TRACKING))
scalar("sc_dedupe_key", "url", urls.dedupe_key, _DEDUPE)
scalar("sc_sql_path", "url", urls.sql_path, "rtrim(split_part(x, '?', 1), '/')")
scalar("sc_match_key_bulk", "url", urls.match_key, f"CASE WHEN x IS NOT NULL THEN {_HOST} || {_SHORT} END")
scalar("sc_tech_url", "url", urls.product_code, "nullif(regexp_extract(x, '/p/(\\d+)', 1), '')")
scalar("sc_locale", "url", urls.locale_of, f"nullif(regexp_extract({_PATH}, '^/(bg|en)(?:/|$)', 1), '')")
scalar("sc_sitemap_url", "url", urls.is_sitemap, f"regexp_matches(lower({_PATH}), '\\.xml(\\.gz)?$') OR contains(lower({_PATH}), 'sitemap')")
scalar("sc_category_candidate", "url", urls.is_category_candidate, f"coalesce(regexp_matches({_PATH}, '^/bg/') AND NOT regexp_matches(lower({_PATH}), '/(p|cart|login|search|blog|help)(/|$)') AND len(list_filter(string_split({_PATH}, '/'), lambda p: p <> '')) BETWEEN 2 AND 4, false)")
scalar("sc_search_redirect", "'https://find.example/l/?a=1&uddg=https%3A%2F%2Fshop.bg%2Fp%2F' || CAST(n2 AS STRING) || '&rut=3'", urls.redirect_target, "'https://shop.bg/p/' || regexp_extract(x, 'Fp%2F(\\d+)', 1)")
scalar("sc_term_match", "url", lambda x: urls.has_term(x, F.lit("red laptops of")), "coalesce(contains(lower(x), 'red') OR contains(lower(x), 'laptops'), false)")
scalar("sc_pagination_urls", "'https://shop.bg/c/' || CAST(n1 AS STRING)", lambda x: F.array_join(urls.page_urls(x, 2), " "), "x || '?page=2 ' || x || '?p=2 ' || x || '/page/2 ' || x || '/page/2/'")
scalar("ex_sku_from_slug", "'name-' || CAST(n2 AS STRING)", urls.sku_of_slug, "'conf-' || lpad(regexp_extract(x, '(\\d+)$', 1), 6, '0')")
scalar("sc_slug_display", "'gaming-part_' || CAST(n2 AS STRING)", urls.slug_display, "'Gaming Part ' || regexp_extract(x, '(\\d+)$', 1)")

# Classifications ---------------------------------------------------------------

_M = "lower(coalesce(x, ''))"
scalar("ex_error_class", "message", fields.error_class, f"CASE WHEN contains({_M}, 'price_missing') THEN 'price_not_found' WHEN regexp_matches({_M}, 'status_404| 404|not found') THEN 'product_not_found' WHEN regexp_matches({_M}, 'status_429|too many requests|rate_limited') THEN 'rate_limited' WHEN contains({_M}, 'http_parse') THEN 'http_parse_failed' WHEN contains({_M}, 'http_blocked') THEN 'http_blocked' WHEN contains({_M}, 'timeout') THEN 'playwright_timeout' WHEN regexp_matches({_M}, 'connection|network') THEN 'network_error' WHEN contains({_M}, 'playwright') THEN 'playwright_timeout' ELSE 'unknown' END")
scalar("ex_block_reason", "message", fields.block_reason, "CASE WHEN contains(x, 'blocked_challenge:') THEN 'challenge_or_captcha' WHEN contains(x, 'status_403:') THEN 'http_403_forbidden' WHEN contains(x, 'status_429:') THEN 'rate_limited' WHEN contains(x, 'status_401:') THEN 'access_denied' END")
scalar("ex_availability", "stock_text", fields.availability, "CASE WHEN regexp_matches(lower(x), 'in stock|available|наличност') THEN 'in_stock' WHEN regexp_matches(lower(x), 'out of stock|изчерпан') THEN 'out_of_stock' WHEN regexp_matches(lower(x), 'pre-?order') THEN 'preorder' END")
scalar("ex_blocked_page", "CAST(200 + n1 * 50 % 350 AS STRING) || '|' || CASE WHEN n3 = 2 THEN 'Checking CAPTCHA' ELSE 'fine' END", lambda x: fields.blocked_page(F.split(x, r"\|")[0].cast("int"), F.split(x, r"\|")[1]), "split_part(x, '|', 1)::INT IN (401, 403, 429) OR split_part(x, '|', 1)::INT >= 500 OR contains(lower(x), 'captcha')")
scalar("ex_needs_fallback", "CASE WHEN n3 = 1 THEN 'failed' ELSE 'ok' END || '|' || CASE WHEN n1 % 4 = 0 THEN '' ELSE CAST(n2 AS STRING) END || '|' || CAST(n3 = 3 AS STRING)", lambda x: fields.needs_fallback(F.split(x, r"\|")[0] == "failed", F.nullif(F.split(x, r"\|")[1], F.lit("")), F.split(x, r"\|")[2] == "true"), "x LIKE 'failed%' OR contains(x, '||') OR x LIKE '%true'")
scalar("ex_product_code", "CASE WHEN n3 = 1 THEN 'SKU: AB-' || CAST(n2 AS STRING) || ' x' WHEN n3 = 2 THEN 'Код на продукта ' || CAST(n2 AS STRING) ELSE 'none' END", fields.product_code, "CASE WHEN x LIKE 'SKU%' THEN regexp_extract(x, 'SKU: (\\S+)', 1) WHEN x LIKE 'Код%' THEN regexp_extract(x, '(\\d+)', 1) END")
scalar("ex_layer", "CASE WHEN n3 < 3 THEN '' WHEN n3 = 4 THEN 'bulk' END", fields.layer, "coalesce(nullif(x, ''), 'playwright')")
scalar("js_stock", "stock_code", fields.stock_code, "CASE x WHEN 'inStock' THEN 'in_stock' WHEN 'outOfStock' THEN 'out_of_stock' WHEN 'lowStock' THEN 'low_stock' ELSE lower(x) END")
scalar("js_spec_lookup", "'{\"size\":\"' || CASE WHEN n3 < 4 THEN '' ELSE 'M' || CAST(n1 AS STRING) END || '\",\"attributes\":{\"size\":\"XL' || CAST(n2 AS STRING) || '\"}}'", lambda x: fields.spec(x, "size"), "coalesce(nullif(x::JSON->>'$.size', ''), nullif(x::JSON->>'$.attributes.size', ''))")
scalar("js_pick_image", "'[{\"format\":\"' || CASE WHEN n3 < 3 THEN 'product' ELSE 'thumb' END || '\",\"url\":\"a' || CAST(n1 AS STRING) || '\"},{\"format\":\"zoom\",\"url\":\"b\"}]'", fields.image, "CASE WHEN contains(x, 'product') THEN x::JSON->>'$[0].url' ELSE 'b' END")
scalar("js_occ_breadcrumb", "'[{\"name\":\"A' || CAST(n1 AS STRING) || '\",\"url\":\"/c/1\"},{\"name\":\"B\",\"url\":\"/x/p/5\"}]'", lambda x: F.array_join(fields.breadcrumb(x), ">"), "x::JSON->>'$[0].name'")
scalar("js_breadcrumb", "'[\"Home\", {\"name\":\"A' || CAST(n1 AS STRING) || '\"}, \"\", {\"title\":\"T\"}, 5]'", lambda x: F.array_join(fields.crumb_names(x), ">"), "'Home>' || (x::JSON->>'$[1].name') || '>T'")
scalar("js_parse_candidates", "'[{\"product_id\":\"' || CAST(n1 AS STRING) || '\",\"match_score\":\"90\"},5,{\"sku\":\"x\"}]'", lambda x: F.array_join(F.transform(fields.candidates(x), lambda c: F.concat_ws(":", c["product_id"], c["match_score"])), ";"), "(x::JSON->>'$[0].product_id') || ':90'")
scalar("js_classifications", "'[{\"name\":\"G\",\"features\":[{\"name\":\"F\",\"featureValues\":[{\"value\":\"' || CAST(n1 AS STRING) || '\"},{\"value\":\"2\"}]}]}]'", fields.classifications, "'G: F=' || (x::JSON->>'$[0].features[0].featureValues[0].value') || ', 2'")
scalar("js_flat_attrs", "'[{\"code\":\"a\",\"value\":\"' || CAST(n1 AS STRING) || '\"},{\"code\":\"b\",\"value\":null}]'", fields.flat_attributes, "'a=' || (x::JSON->>'$[0].value')")
scalar("js_merge_raw", "'a=' || CAST(n1 AS STRING) || ';b=2|b=' || CAST(n3 AS STRING) || ';c=4'", lambda x: F.array_join(F.array_sort(F.transform(F.map_entries(fields.merged(F.str_to_map(F.split(x, r"\|")[0], F.lit(";"), F.lit("=")), F.str_to_map(F.split(x, r"\|")[1], F.lit(";"), F.lit("=")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"), "split_part(x, ';', 1) || ';' || split_part(x, '|', 2)")
scalar("sc_spec_label", "CASE n3 WHEN 1 THEN 'Цвят:' WHEN 2 THEN 'RAM памет' WHEN 3 THEN 'Storage' WHEN 4 THEN 'Марка' WHEN 5 THEN 'Model' ELSE 'друго' END", fields.spec_label, "CASE x WHEN 'Цвят:' THEN 'color' WHEN 'RAM памет' THEN 'memory' WHEN 'Storage' THEN 'storage' WHEN 'Марка' THEN 'brand' WHEN 'Model' THEN 'model' END")
scalar("sc_code_priority", "'mpn=' || CASE WHEN n3 = 1 THEN '' ELSE 'M' || CAST(n1 AS STRING) END || ';code=C' || CAST(n2 AS STRING) || ';sku=M' || CAST(n1 AS STRING)", lambda x: F.array_join(fields.codes_by_priority(F.str_to_map(x, F.lit(";"), F.lit("=")), ("mpn", "code", "sku")), ","), "CASE WHEN x LIKE 'mpn=;%' THEN regexp_extract(x, 'code=([^;]*)', 1) || ',' || regexp_extract(x, 'sku=(.*)$', 1) ELSE regexp_extract(x, 'mpn=([^;]*)', 1) || ',' || regexp_extract(x, 'code=([^;]*)', 1) END")
scalar("sc_join_path", "CAST(n1 AS STRING) || ';' || CAST(n2 AS STRING)", lambda x: F.concat_ws(" | ", fields.path_text(F.split(x, ";")), fields.attributes_text(F.create_map(F.lit("a"), x))), "replace(x, ';', ' > ') || ' | a: ' || x")


# On tables ---------------------------------------------------------------------


@query("flt_host_match", "SELECT page_id FROM pages WHERE regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') = 'tionsh.example.net'")
def flt_host_match(d: Domain) -> DataFrame:
    return d.pages.where(urls.domain(F.col("url")) == "tionsh.example.net").select("page_id")


@query("dd_by_url", "SELECT host, path, min(page_id) AS page_id FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages) GROUP BY ALL")
def dd_by_url(d: Domain) -> DataFrame:
    u = F.col("url")
    return d.pages.groupBy(F.lower(F.regexp_extract(u, "^https?://([^/?#]*)", 1)).alias("host"), F.regexp_replace(urls.path_of(u), "/+$", "").alias("path")).agg(F.min("page_id").alias("page_id"))


@query("dd_by_code", "SELECT code, page_id FROM (SELECT page_id, code, row_number() OVER (PARTITION BY code ORDER BY loc <> 'de', page_id) AS rn FROM (SELECT page_id, regexp_extract(url, '/(\\d+)', 1) AS code, regexp_extract(url, '/([a-z]{2})/', 1) AS loc FROM pages)) WHERE rn = 1")
def dd_by_code(d: Domain) -> DataFrame:
    rows = d.pages.select("page_id", F.regexp_extract("url", r"/(\d+)", 1).alias("code"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("loc"))
    return first_of(rows, ["code"], [(F.col("loc") != "de").asc(), F.asc("page_id")]).select("code", "page_id")


@query("jn_anti_discovery", "SELECT min(url) AS url FROM (SELECT url, rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS k FROM pages) WHERE k NOT IN (SELECT rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') FROM pages WHERE page_id % 2 = 0) GROUP BY k")
def jn_anti_discovery(d: Domain) -> DataFrame:
    from tallymart.operators.upserts import undiscovered

    key = lambda c: F.regexp_replace(urls.path_of(c), "/+$", "")
    return undiscovered(d.pages.select("url"), d.pages.where("page_id % 2 = 0").select("url"), key).select("url")


@query("set_intersect_tokens", "SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS j FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 JOIN LATERAL (SELECT list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9]+')) AS t) x ON true JOIN LATERAL (SELECT list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS t) y ON true")
def set_intersect_tokens(d: Domain) -> DataFrame:
    t = d.benchmark.select("item_id", codes.word_tokens(F.col("text")).alias("t"))
    rows = t.select(F.col("item_id").alias("a"), F.col("t").alias("x")).join(t.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("t").alias("y")), "a")
    return rows.select("a", "b", F.round(codes.jaccard(F.col("x"), F.col("y")), 6).alias("j"))


@query("tr_from_urls", "WITH u AS (SELECT DISTINCT url, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS s FROM pages) SELECT url, greatest(0, least(3, len(s) - 2))::INT AS level FROM u")
def tr_from_urls(d: Domain) -> DataFrame:
    from tallymart.operators.trees import parents_of_urls

    return parents_of_urls(d.pages).select("url", "level")


@query("src_seedterms", "SELECT DISTINCT lower(term) AS term FROM (SELECT unnest([brand, model, manufacturer_code, ean, sku, brand || ' ' || name, name]) AS term FROM products) WHERE length(trim(term)) BETWEEN 3 AND 80")
def src_seedterms(d: Domain) -> DataFrame:
    terms = F.array("brand", "model", "manufacturer_code", "ean", "sku", F.concat_ws(" ", F.when(F.col("brand").isNotNull(), F.col("brand")), F.when(F.col("brand").isNotNull(), F.col("name"))), "name")
    return d.products.select(F.explode(terms).alias("term")).where("length(trim(term)) BETWEEN 3 AND 80").select(F.lower("term").alias("term")).distinct()


@query("dd_seed_terms", "SELECT DISTINCT trim(t) AS term FROM (SELECT unnest(string_split(p_type, ' ')) AS t FROM part) WHERE trim(t) <> ''")
def dd_seed_terms(d: Domain) -> DataFrame:
    return d.part.select(F.explode(F.split("p_type", " ")).alias("t")).select(F.trim("t").alias("term")).where("term <> ''").distinct()


@query("flt_namespace_majority", "WITH h AS (SELECT page_id, contains(url, '/en/') AS hit FROM pages), s AS (SELECT avg(hit::INT) AS share, count(*) AS n FROM h) SELECT page_id FROM h, s WHERE hit OR NOT (n >= 100 AND share >= 0.5)")
def flt_namespace_majority(d: Domain) -> DataFrame:
    h = d.pages.select("page_id", F.col("url").contains("/en/").alias("hit"))
    s = h.agg(F.avg(F.col("hit").cast("int")).alias("share"), F.count("*").alias("n")).withColumn("_k", F.lit(1))
    return h.withColumn("_k", F.lit(1)).join(s, "_k").where("hit OR NOT (n >= 100 AND share >= 0.5)").select("page_id")
