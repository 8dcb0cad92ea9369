"""URLs and hosts. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRACKING_PREFIXES = ("utm_", "mc_")
TRACKING = ("fbclid", "gclid", "ref", "source", "campaign", "affiliate")
STATIC_ENDINGS = ("css", "gif", "ico", "jpeg", "jpg", "js", "json", "pdf", "png", "svg", "webp", "xml", "zip")
LISTING_STATE = ("page", "p", "per_page", "limit", "offset", "start", "sort", "sort_by", "sortby", "orderby", "order", "dir", "view")


def domain(x: Column) -> Column:
    """Host of a URL or bare domain: lower case, without port, ``www.`` and final dot."""
    raw = F.trim(F.coalesce(x, F.lit("")))
    rest = F.regexp_replace(raw, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|:\d*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"\.+$", ""), r"^www\.", "")


def full_url(x: Column) -> Column:
    """A URL with a scheme, https where there was none."""
    raw = F.trim(F.coalesce(x, F.lit("")))
    return F.when((raw == "") | raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), F.regexp_replace(raw, "^/+", "")))


def _kept(query: Column, exact: tuple[str, ...]) -> Column:
    """Parameters that aren't tracking or in ``exact`` and have a value, joined again."""
    name = lambda p: F.lower(F.split(p, "=", 2)[0])
    tracked = lambda p: F.coalesce(F.array_contains(F.array(*map(F.lit, exact)), name(p)), F.lit(False)) | name(p).rlike("^(?:" + "|".join(TRACKING_PREFIXES) + ")")
    return F.array_join(F.filter(F.split(query, "&"), lambda p: p.rlike("=.") & ~tracked(p)), "&")


def strip_query(query: Column) -> Column:
    """A query string without tracking and listing-state parameters, and without blank values."""
    return _kept(query, TRACKING + LISTING_STATE)


def strip_tracking(query: Column) -> Column:
    """A query string without tracking parameters; paging stays."""
    return _kept(query, TRACKING)


def query_of(x: Column) -> Column:
    return F.regexp_extract(x, r"\?([^#]*)", 1)


def path_of(x: Column) -> Column:
    return F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def product_url(x: Column) -> Column:
    """A canonical product URL: http(s), lower-case host, no final slash, no tracking or listing state, no fragment; null for other schemes and static files."""
    scheme, host = F.lower(F.regexp_extract(x, r"(?i)^(https?)://", 1)), F.lower(F.regexp_extract(x, r"(?i)^https?://([^/?#]*)", 1))
    path = F.regexp_replace(path_of(x), "/+$", "")
    query = strip_query(query_of(x))
    static = path.rlike(r"(?i)\.(?:" + "|".join(STATIC_ENDINGS) + ")$")
    return F.when((host != "") & ~static, F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def dedupe_key(x: Column) -> Column:
    """Path without final slash, and the query that is kept."""
    query = strip_query(query_of(x))
    return F.concat(F.regexp_replace(path_of(x), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def sql_path(x: Column) -> Column:
    """All before the query, without final slashes."""
    return F.rtrim(F.split_part(x, F.lit("?"), F.lit(1)), F.lit("/"))


def match_key(x: Column) -> Column:
    """Host without ``www.`` and path without final slash."""
    return F.concat(domain(x), F.regexp_replace(path_of(x), "/+$", ""))


def product_code(x: Column) -> Column:
    """The digits after ``/p/``."""
    return F.nullif(F.regexp_extract(x, r"/p/(\d+)", 1), F.lit(""))


def locale_of(x: Column) -> Column:
    """``bg`` or ``en`` as the first segment of the path."""
    return F.nullif(F.regexp_extract(path_of(x), r"^/(bg|en)(?:/|$)", 1), F.lit(""))


def is_sitemap(x: Column) -> Column:
    """Whether a URL looks like that of a sitemap."""
    low = F.lower(path_of(x))
    return low.rlike(r"\.xml(?:\.gz)?$") | low.contains("sitemap")


def sku_of_slug(x: Column) -> Column:
    """``conf-`` and the final digits of a slug, padded to six."""
    digits = F.regexp_extract(x, r"(\d+)/?$", 1)
    return F.when(digits != "", F.concat(F.lit("conf-"), F.lpad(digits, 6, "0")))


# Fixed values.
NOT_CATEGORIES = r"/(?:p|cart|login|search|blog|help)(?:/|$)"


def segments(x: Column) -> Column:
    """The segments of a URL's path."""
    return F.filter(F.split(path_of(x), "/"), lambda s: s != "")


def is_category_candidate(x: Column) -> Column:
    """Whether a URL below ``/bg/`` may be a category: one to three segments more, none of them excluded."""
    path = path_of(x)
    return F.coalesce(path.rlike("^/bg/") & ~F.lower(path).rlike(NOT_CATEGORIES) & F.size(segments(x)).between(2, 4), F.lit(False))


def redirect_target(x: Column) -> Column:
    """The URL that a search result's redirect leads to; other URLs as they are."""
    return F.coalesce(*(F.try_url_decode(F.nullif(F.regexp_extract(x, rf"[?&]{k}=([^&#]+)", 1), F.lit(""))) for k in ("uddg", "u", "url")), x)


def has_term(x: Column, terms: Column) -> Column:
    """Whether a decoded URL holds any word of three letters or more of a search."""
    low = F.lower(F.coalesce(F.try_url_decode(x), x))
    words = F.filter(F.split(F.lower(terms), r"\W+"), lambda t: F.length(t) >= 3)
    return F.coalesce(F.exists(words, lambda t: low.contains(t)), F.lit(False))


def page_urls(x: Column, page: int) -> Column:
    """The URLs under which shops give a further page of a listing."""
    base = F.regexp_replace(x, "[?#].*$|/+$", "")
    return F.array(*(F.concat(base, F.lit(f"{mark}{page}{end}")) for mark, end in (("?page=", ""), ("?p=", ""), ("/page/", ""), ("/page/", "/"))))


def slug_display(x: Column) -> Column:
    """A slug as words with capitals."""
    return F.initcap(F.regexp_replace(x, "[-_]+", " "))


def feed_url(canonical: Column, key: Column, base: Column) -> Column:
    """The canonical URL of a feed item, else its key below the shop's base."""
    return F.coalesce(F.nullif(canonical, F.lit("")), F.concat(F.regexp_replace(base, "/+$", "/"), key))
