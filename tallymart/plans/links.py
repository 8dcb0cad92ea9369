"""Queries over found links: what is a product, a listing or a brand, and what of it a site keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.functions import product_urls as p
from tallymart.functions import urls
from tallymart.plans.registry import query
from tallymart.sources.adapters import Domain


def _in(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PATH = "regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?', ''), ';[^/]*$', '')"
_CUT = f"SELECT *, {_PATH} AS path, list_filter(string_split(lower({_PATH}), '/'), lambda s: s <> '') AS seg, regexp_extract(url, '\\?([^#]*)', 1) AS qs FROM"
_PARTS = "SELECT *, coalesce(seg[-1], '') AS last, string_split(coalesce(seg[-1], ''), '-') AS words, coalesce(seg[1], '') AS head FROM"
_STATIC = f"regexp_matches(path, '(?i)\\.({'|'.join(urls.STATIC_ENDINGS)})$')"
_DIGITS = "regexp_matches(last, '[a-zа-я][a-zа-я0-9-]*[0-9]|[0-9][a-zа-я0-9-]*[a-zа-я]')"
_LONG = f"({_DIGITS} AND len(words) > 2 AND length(last) >= 12)"
_ID = "regexp_matches(qs, '(?i)(^|&)(id|product_id|sku|pid)=[^&]')"
_HINTED = f"list_has_any(seg, {_in(p.PRODUCT_HINTS)})"
_LEGAL = f"(last LIKE '%-brand' OR list_has_any(words, {_in(p.NOT_IN_SLUG)}))"
_USABLE = f"(len(seg) > 0 AND NOT list_has_any(seg, {_in(p.EXCLUDED)}))"
_OWN = f"NOT list_contains({_in(p.FOREIGN_SEGMENTS)}, head) AND NOT list_contains({_in(p.FOREIGN_TERMS)}, last)"
_WORDY = "regexp_matches(last, '^[a-zа-я0-9]+(-[a-zа-я0-9]+){2,}$')"
_PRODUCT = f"({_USABLE} AND NOT {_STATIC} AND NOT {_LEGAL} AND (({_HINTED} AND regexp_matches(path, '[0-9]{{3,}}')) OR {_LONG} OR {_ID}))"
_EXTERNAL = f"({_USABLE} AND {_OWN} AND NOT list_has_any(words, {_in(p.FOREIGN_TERMS)}) AND ({_PRODUCT} OR (qs = '' AND len(seg) BETWEEN 2 AND 4 AND {_WORDY} AND length(last) >= 16 AND len(words) > 3)))"
_LOOSE = f"CASE WHEN {_HINTED} THEN length(last) >= 6 AND ({_WORDY} OR {_DIGITS}) ELSE {_ID} OR (NOT list_has_any(seg[1:-2], {_in(p.CATEGORY_HINTS)}) AND {_LONG}) END"
_DYNAMIC = f"({_USABLE} AND {_OWN} AND last NOT LIKE 'sbf-%' AND NOT contains(last, 'uslovija') AND ({_PRODUCT} OR (NOT {_LEGAL} AND {_LOOSE})))"
_LISTED = f"({_USABLE} AND NOT {_STATIC} AND len(seg) >= 3 AND {_OWN} AND NOT starts_with(last, 'productsegment_') AND len(words) > 2 AND regexp_matches(last, '[0-9]{{3,}}'))"


@query("sc_is_product_url", f"SELECT id, coalesce({_PRODUCT}, false) AS strict, coalesce({_EXTERNAL}, false) AS external, coalesce({_DYNAMIC}, false) AS dynamic, coalesce({_LISTED}, false) AS listed FROM ({_PARTS} ({_CUT} links))")
def is_product(d: Domain) -> DataFrame:
    x = F.col("url")
    return d.links.select("id", p.is_product(x).alias("strict"), p.is_external_product(x).alias("external"), p.is_dynamic_product(x).alias("dynamic"), p.is_listed_product(x).alias("listed"))


@query(
    "sc_is_listing_url",
    f"SELECT id, coalesce(NOT {_STATIC} AND NOT list_has_any(seg, {_in(p.EXCLUDED)}) AND (list_has_any(seg, {_in(p.CATEGORY_HINTS)}) OR len(seg) <= 2), false) AS listing, coalesce(len(seg) = 2 AND list_contains({_in(p.BRAND_INDEXES)}, head), false) AS brand FROM ({_PARTS} ({_CUT} links))",
)
def is_listing(d: Domain) -> DataFrame:
    return d.links.select("id", p.is_listing(F.col("url")).alias("listing"), p.is_brand_listing(F.col("url")).alias("brand"))


_DROPPED = "utm_[^=&]*|mc_[^=&]*|fbclid|gclid|ref|source|campaign|affiliate|page|p|per_page|limit|offset|start|sort|sort_by|sortby|orderby|order|dir|view"
_FOUND = f"""
WITH own AS (SELECT site, channel, lower(regexp_extract(url, '(?i)^(https?://[^/?#]*)', 1)) || rtrim(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/') AS base,
    array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda q: regexp_matches(q, '=.') AND NOT regexp_matches(q, '(?i)^({_DROPPED})=')), '&') AS kept
  FROM links WHERE regexp_replace(regexp_extract(lower(url), '^(https?://)?([^/?#:]*)', 2), '^www\\.', '') = site AND regexp_matches(url, '(?i)^https?://')),
canonical AS (SELECT site, channel, base || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url FROM own),
parts AS ({_PARTS} ({_CUT} canonical)),
chosen AS (SELECT DISTINCT site, url, {_HINTED} AS hinted FROM parts WHERE NOT {_STATIC} AND CASE channel WHEN 'external' THEN {_EXTERNAL} WHEN 'dynamic' THEN {_DYNAMIC} ELSE {_PRODUCT} END),
counted AS (SELECT *, count(*) OVER (PARTITION BY site) AS n, count(*) FILTER (WHERE hinted) OVER (PARTITION BY site) AS k FROM chosen)
SELECT site, url FROM counted WHERE hinted OR n < {p.HINTED_FROM} OR 2 * k < n"""


@query("ex_found_filter", _FOUND)
def found(d: Domain) -> DataFrame:
    return p.found_products(d.links)
