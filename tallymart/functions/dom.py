"""Search in the flat tree of a document (``sources.tree``): selectors, texts, prices and noise, as column expressions.

A node's descendants are those from its own number up to ``until``, so what an
ancestor has to be is a test of intervals.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymart.functions.money import currency_code, parse_decimal

# Selectors in the order in which they are tried, and words of containers that show other products or the page's frame.
TITLES = ('meta[property="og:title"]', 'meta[name="twitter:title"]', '[itemprop="name"]', "h1", ".product-title", ".product__title", '[class*="product"][class*="title"]', "title")
PRICES = ("#ProductPrice", ".single-product-price", ".product-detail-price", ".product-info .final-price", '[itemprop="price"]', 'meta[property="product:price:amount"]', 'meta[property="og:price:amount"]', "[data-price]", "[data-product-price]", ".current-price", ".sale-price", ".product-price", ".price-current", ".price", '[class*="price"]')
OLD_PRICES = ("s", "del", "strike", ".old-price", ".was-price", ".regular-price", ".list-price", '[class*="old"][class*="price"]', '[class*="regular"][class*="price"]')
IMAGES = ('meta[property="og:image"]', 'meta[name="twitter:image"]', 'link[rel="image_src"]', '[itemprop="image"]', "img.product-image", ".product-gallery img", "picture img")
EANS = ('[itemprop="gtin13"]', '[itemprop="gtin14"]', '[itemprop="gtin12"]', '[itemprop="gtin8"]', '[itemprop="gtin"]', 'meta[property="product:ean"]', 'meta[property="og:barcode"]')
MPNS = ('[itemprop="mpn"]', 'meta[property="product:mfr_part_no"]')
NOISE = r"(?iU)related|similar|recommend|upsell|cross-?sell|also-?bought|carousel|slider|swiper|recently|viewed|bestseller|featured|mini-?cart|footer|breadcrumb|\bnav\b|menu|sidebar"
UNIT = r"лв\.?|bgn|€|eur|\$|usd|£|gbp"
IN_STOCK = (r"\b(in stock|available|наличност|в наличност)\b", "in_stock"), (r"\b(out of stock|sold out|изчерпан|няма наличност|не е наличен)\b", "out_of_stock"), (r"\b(pre[- ]?order|очакваме|по заявка)\b", "preorder")

#: Nodes of one selector that are looked at.
TRIED = 10
_PART = re.compile(r"([#.]?[\w-]+)|\[([\w-]+)(?:(\*?=)\"([^\"]*)\")?\]")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often and wherever it is used."""
    return F.transform(F.array(value), then)[0]


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def filled_text(x: Column) -> Column:
    """A trimmed text; null where nothing is left."""
    return F.nullif(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(""))


def attr(node: Column, name: str) -> Column:
    """An attribute of a node; null where it is absent or empty."""
    return F.nullif(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def _test(compound: str) -> Callable[[Column], Column]:
    """Whether a node has the tag, id, classes and attributes that a selector without blanks names."""

    def holds(n: Column) -> Column:
        out = F.lit(True)
        for name, key, op, value in _PART.findall(compound):
            if key:
                have = F.try_element_at(n["attrs"], F.lit(key))
                out = out & F.coalesce(have.isNotNull() if not op else have == value if op == "=" else have.contains(value), F.lit(False))
            elif name[0] == "#":
                out = out & F.coalesce(F.try_element_at(n["attrs"], F.lit("id")) == name[1:], F.lit(False))
            elif name[0] == ".":
                out = out & F.array_contains(n["classes"], name[1:])
            else:
                out = out & (n["tag"] == name)
        return out

    return holds


def inside(nodes: Column, of: Column) -> Column:
    """The ``nodes`` that one of ``of`` holds."""
    return once(of, lambda spans: F.filter(nodes, lambda n: F.exists(spans, lambda a: (a["id"] < n["id"]) & (n["id"] < a["until"]))))


def select(nodes: Column, selector: str) -> Column:
    """The nodes that a selector finds, in document order; blanks stand for any descent."""
    *above, own = selector.split(" ")
    found = F.filter(nodes, _test(own))
    for a in above:
        found = inside(found, F.filter(nodes, _test(a)))
    return found


def below(nodes: Column, n: Column) -> Column:
    """The nodes that ``n`` holds."""
    return F.slice(nodes, n["id"] + 2, n["until"] - n["id"] - 1)


def text(nodes: Column, n: Column) -> Column:
    """All that is shown of a node, its pieces joined by blanks."""
    return all_text(below(nodes, n))


def all_text(nodes: Column) -> Column:
    return F.array_join(F.transform(F.filter(nodes, lambda t: t["tag"] == "#text"), lambda t: t["text"]), " ")


def data(nodes: Column, n: Column) -> Column:
    """What a script holds."""
    return F.array_join(F.transform(F.filter(below(nodes, n), lambda t: t["tag"] == "#data"), lambda t: t["text"]), "")


def scripts(nodes: Column, kind: str = "application/ld+json") -> Column:
    """The bodies of the scripts of one type."""
    return F.transform(F.filter(nodes, lambda n: (n["tag"] == "script") & F.coalesce(attr(n, "type") == kind, F.lit(False))), lambda n: data(nodes, n))


def path(url: Column) -> Column:
    """The path of a URL or reference, without slashes at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^(?:[a-zA-Z][\w+.-]*:)?//[^/]*", ""), "/+$", "")


def absolute(reference: Column, base: Column) -> Column:
    """A reference resolved against a page's URL; steps upwards stay as they are."""
    origin, scheme = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-zA-Z][\w+.-]*://[^/]*(?:/.*(?=/[^/]*$))?)", 1)
    r = F.trim(reference)
    return F.when(r.rlike(r"^[a-zA-Z][\w+.-]*:"), r).when(r.startswith("//"), F.concat(scheme, r)).when(r.startswith("/"), F.concat(origin, r)).otherwise(F.concat(folder, F.lit("/"), r))


def noise(nodes: Column, url: Column) -> Column:
    """What prices aren't taken from: containers named for other products or the page's frame, and links to other pages."""

    def is_noise(n: Column) -> Column:
        named = F.concat_ws(" ", F.array_join(n["classes"], " "), F.try_element_at(n["attrs"], F.lit("id"))).rlike(NOISE)
        leads = path(F.coalesce(F.try_element_at(n["attrs"], F.lit("href")), F.lit("")))
        return F.coalesce(named | ((n["tag"] == "a") & (leads != "") & (leads != path(F.coalesce(url, F.lit(""))))), F.lit(False))

    return F.filter(nodes, is_noise)


AMOUNT = rf"(?iU)((?:(?:{UNIT})\s*)?\d[\d\s.,]*(?:[.,]\d{{1,2}})?\s*(?:{UNIT})?)"


def _priced(m: Column) -> Column:
    """(amount, currency) of a number with its unit."""
    unit = F.coalesce(F.nullif(F.regexp_extract(m, rf"(?iU)^({UNIT})", 1), F.lit("")), F.nullif(F.regexp_extract(m, rf"(?iU)({UNIT})$", 1), F.lit("")))
    return F.struct(parse_decimal(m).cast("decimal(18,4)").alias("amount"), currency_code(unit).alias("currency"))


def prices_in(x: Column) -> Column:
    """(amount, currency) of all numbers above 0 in a text; the currency stands before or after, or isn't told."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(AMOUNT), F.lit(1)), _priced), lambda c: c["amount"] > 0)


def _prices_or_first(x: Column) -> Column:
    """:func:`prices_in`, and after them the first number even if it is 0."""
    return F.concat(prices_in(x), F.filter(F.array(_priced(F.regexp_extract(x, AMOUNT, 1))), lambda c: c["amount"].isNotNull()))


def first_price(nodes: Column, url: Column, selectors: tuple[str, ...], preferred: str | None = None) -> Column:
    """(amount, currency, selector) of the price that the selectors find outside noise.

    The first in the preferred currency counts, else the first with any, else
    the first.
    """

    said = lambda n: F.concat_ws(" ", *(attr(n, k) for k in ("content", "data-price", "data-product-price", "data-value")), text(nodes, n))
    tried = lambda s: F.transform(F.slice(select(nodes, s), 1, TRIED), lambda n: F.struct(n.alias("n"), F.lit(s).alias("s")))
    hits = F.concat(*map(tried, selectors))
    best = [lambda c: c["currency"].isNotNull(), lambda c: F.lit(True)]
    if preferred:
        best.insert(0, lambda c: F.coalesce(c["currency"] == preferred, F.lit(False)))

    def of(bad: Column) -> Column:
        own = F.filter(hits, lambda h: ~F.exists(bad, lambda a: (a["id"] < h["n"]["id"]) & (h["n"]["id"] < a["until"])))
        amounts = lambda h: F.transform(once(said(h["n"]), _prices_or_first), lambda c: F.struct(c["amount"].alias("amount"), c["currency"].alias("currency"), h["s"].alias("selector")))
        return once(F.flatten(F.transform(own, amounts)), lambda found: F.coalesce(*(first(F.filter(found, b)) for b in best)))

    return once(noise(nodes, url), of)


def shown(nodes: Column, selectors: tuple[str, ...], value: Callable[[Column], Column]) -> Column:
    """The first value that the first node of a selector gives, selectors in order."""
    firsts = F.filter(F.array(*(first(select(nodes, s)) for s in selectors)), lambda n: n.isNotNull())
    return first(F.filter(F.transform(firsts, value), lambda x: x.isNotNull()))


def title(nodes: Column) -> Column:
    """The title by ``TITLES``, of two characters at least."""

    def of(n: Column) -> Column:
        t = filled_text(F.coalesce(attr(n, "content"), text(nodes, n)))
        return F.when(F.length(t) > 1, F.left(t, F.lit(512)))

    return shown(nodes, TITLES, of)


def image(nodes: Column, url: Column) -> Column:
    """The image by ``IMAGES``, as an absolute URL."""
    return shown(nodes, IMAGES, lambda n: absolute(F.coalesce(attr(n, "content"), attr(n, "href"), attr(n, "src")), url))


def stock_of(x: Column) -> Column:
    """The first stock state whose words occur in a text."""
    return F.coalesce(*(F.when(x.rlike("(?iU)" + p), F.lit(v)) for p, v in IN_STOCK))
