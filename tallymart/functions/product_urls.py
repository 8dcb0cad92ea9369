"""Which URLs are those of products, of listings and of brands, as column expressions over the segments of the path.

Three rules tell products: one for URLs that a shop itself lists, one for those
that others link to and one for those met while crawling. A null URL is neither.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.functions import urls

# Fixed values.
EXCLUDED = (
    "account beautyblog blog brand brands campaign cart categories category checkout compare contact contacts deals delivery dostavka faq garancia garantsiya "
    "help info kampanii kontakti label label-campaign labels landing login logout lps magazini marka marki nav news novini pomosht pravila privacy "
    "proizvoditeli promocii promotsii register salon saloni salons search services store-locator stores tag tags terms uslugi usloviya wishlist za-nas "
    "категории марка марки"
).split()
NOT_IN_SLUG = "campaign cookies gdpr kampanija politika pravila promo uslovija usloviya".split()
PRODUCT_HINTS = "p pd dp product products prod item items offer offers".split()
CATEGORY_HINTS = "c cat cats catalog categories category collections kategorii shop store продукти категории".split()
FOREIGN_TERMS = "black-friday campaign clearance discount offer offers promo promos promotsii sale sales".split()
FOREIGN_SEGMENTS = "beautyblog category collection collections help kozmetika majka-i-dete nay-prodavani-parfyumi oferti parfyumi pregledi reviews shopping-days summer-black-friday sbf".split()
BRAND_INDEXES = "brand brands marka marki марка марки".split()
NUMBER = r"\p{Nd}{3,}"
SLUG_WITH_DIGITS = r"[a-zа-я][a-zа-я0-9-]*\p{Nd}|\p{Nd}[a-zа-я0-9-]*[a-zа-я]"
WORDY_SLUG = r"^[a-zа-я0-9]+(?:-[a-zа-я0-9]+){2,}$"
ID_IN_QUERY = r"(?i)(?:^|&)(?:id|product_id|sku|pid)=[^&]"
#: Found URLs of a site from which on its product namespace, if half of them share one, is taken to hold all products.
HINTED_FROM = 100


def path(x: Column) -> Column:
    """The path of a URL with or without scheme and host, without parameters of its last segment."""
    rest = F.regexp_replace(F.regexp_replace(x, "[?#].*$", ""), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?", "")
    return F.regexp_replace(rest, ";[^/]*$", "")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it; plans stay small."""
    return F.transform(F.array(value), f)[0]


def _cut(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of the parts of a URL (path, query, segments in lower case, the first and the last of them, words of the last); false for null."""

    def ends(u: Column) -> Column:
        end = lambda k: F.coalesce(F.try_element_at(u["segments"], F.lit(k)), F.lit(""))
        return F.struct(u["path"].alias("path"), u["query"].alias("query"), u["segments"].alias("segments"), end(1).alias("first"), end(-1).alias("last"), F.split(end(-1), "-").alias("words"))

    named = F.struct(path(x).alias("path"), urls.query_of(x).alias("query"))
    listed = lambda u: F.struct(u["path"].alias("path"), u["query"].alias("query"), F.filter(F.split(F.lower(u["path"]), "/"), lambda s: s != "").alias("segments"))
    return F.coalesce(_let(named, lambda u: _let(listed(u), lambda v: _let(ends(v), f))), F.lit(False))


def _any(found: Column, words: Iterable[str]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, words)))


def _usable(u: Column) -> Column:
    """Whether there is a path and none of its segments is excluded."""
    return (F.size(u["segments"]) > 0) & ~_any(u["segments"], EXCLUDED)


def _static(u: Column) -> Column:
    """Whether the path is that of a file that pages load or offer."""
    return u["path"].rlike(r"(?i)\.(?:" + "|".join(urls.STATIC_ENDINGS) + ")$")


def _legal(u: Column) -> Column:
    """Whether the last segment is that of a brand, or of a legal or promotional page."""
    return u["last"].endswith("-brand") | _any(u["words"], NOT_IN_SLUG)


def _hinted(u: Column) -> Column:
    return _any(u["segments"], PRODUCT_HINTS)


def _long_slug(u: Column) -> Column:
    """Whether the last segment has letters beside digits, two hyphens and twelve characters; leaves of a category tree are shorter."""
    return u["last"].rlike(SLUG_WITH_DIGITS) & (F.size(u["words"]) > 2) & (F.length(u["last"]) >= 12)


def _foreign(u: Column) -> Column:
    """Whether a shop's sections of offers, reviews or collections are above, or the last segment is a term of sales."""
    return u["first"].isin(FOREIGN_SEGMENTS) | u["last"].isin(FOREIGN_TERMS)


def _product(u: Column) -> Column:
    return _usable(u) & ~_static(u) & ~_legal(u) & ((_hinted(u) & u["path"].rlike(NUMBER)) | _long_slug(u) | u["query"].rlike(ID_IN_QUERY))


def _external(u: Column) -> Column:
    wordy = (u["query"] == "") & F.size(u["segments"]).between(2, 4) & u["last"].rlike(WORDY_SLUG) & (F.length(u["last"]) >= 16) & (F.size(u["words"]) > 3)
    return _usable(u) & ~_foreign(u) & ~_any(u["words"], FOREIGN_TERMS) & (_product(u) | wordy)


def _dynamic(u: Column) -> Column:
    above = F.slice(u["segments"], F.lit(1), F.greatest(F.size(u["segments"]) - 1, F.lit(0)))
    slug = (F.length(u["last"]) >= 6) & (u["last"].rlike(WORDY_SLUG) | u["last"].rlike(SLUG_WITH_DIGITS))
    loose = F.when(_hinted(u), slug).otherwise(u["query"].rlike(ID_IN_QUERY) | (~_any(above, CATEGORY_HINTS) & _long_slug(u)))
    return _usable(u) & ~_foreign(u) & ~u["last"].startswith("sbf-") & ~u["last"].contains("uslovija") & (_product(u) | (~_legal(u) & loose))


def hinted(x: Column) -> Column:
    """Whether a segment of the path says that products are below it."""
    return _cut(x, _hinted)


def is_product(x: Column) -> Column:
    """Whether a URL of a shop's own lists looks like a product: a hint and a number of three digits, a long slug, or an id in the query."""
    return _cut(x, _product)


def is_external_product(x: Column) -> Column:
    """The rule for URLs that others link to: no sales pages; slugs of many words at depth two to four are products as well."""
    return _cut(x, _external)


def is_dynamic_product(x: Column) -> Column:
    """The rule for URLs met while crawling: below a hint any slug will do, below a category namespace none."""
    return _cut(x, _dynamic)


def is_listed_product(x: Column) -> Column:
    """Whether a link of a listing page leads to a product by its depth of three and a slug with a number."""
    return _cut(x, lambda u: _usable(u) & ~_static(u) & (F.size(u["segments"]) >= 3) & ~_foreign(u) & ~u["last"].startswith("productsegment_") & (F.size(u["words"]) > 2) & u["last"].rlike(NUMBER))


def is_found_product(x: Column, channel: Column) -> Column:
    """The rule of the channel that a URL was found by: ``external``, ``dynamic``, else the strict one."""
    return _cut(x, lambda u: F.when(channel == "external", _external(u)).when(channel == "dynamic", _dynamic(u)).otherwise(_product(u)))


def is_listing(x: Column) -> Column:
    """Whether a URL looks like a listing page: the start page, a category hint, or at most two segments."""
    return _cut(x, lambda u: ~_static(u) & ~_any(u["segments"], EXCLUDED) & (_any(u["segments"], CATEGORY_HINTS) | (F.size(u["segments"]) <= 2)))


def is_brand_listing(x: Column) -> Column:
    """Whether a URL lists the products of one brand."""
    return _cut(x, lambda u: (F.size(u["segments"]) == 2) & u["first"].isin(BRAND_INDEXES))


def _of_site(url: Column, site: Column) -> Column:
    """Whether the host of a URL is that of a site, ``www.`` aside."""
    return urls.domain(url) == urls.domain(site)


def found_products(rows: DataFrame, least: int = HINTED_FROM) -> DataFrame:
    """(site, url) of the products among found URLs (site, url, channel), each once in its canonical form.

    The rule goes by the channel: ``external``, ``dynamic``, else the strict one.
    Of a site with ``least`` products of which half or more are below a product
    hint, those outside are dropped as pages of categories and series. Null
    sites, null URLs and URLs of other hosts give nothing. Counts by site are one
    small row each and are joined back, so a large site isn't gathered in a task.
    """
    own = rows.where(_of_site(F.col("url"), F.col("site"))).select("site", urls.product_url(F.col("url")).alias("url"), "channel").where("url IS NOT NULL")
    products = own.where(is_found_product(F.col("url"), F.col("channel"))).select("site", "url", hinted(F.col("url")).alias("hinted")).distinct()
    spaced = products.groupBy("site").agg(F.count("*").alias("n"), F.count_if("hinted").alias("k")).where((F.col("n") >= least) & (2 * F.col("k") >= F.col("n"))).select("site", F.lit(True).alias("spaced"))
    return products.join(spaced, "site", "left").where("hinted OR spaced IS NULL").select("site", "url")
