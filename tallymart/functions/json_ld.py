"""Products in JSON-LD: a walk over JSON of any shape, as column expressions over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymart.functions.codes import gtin_valid
from tallymart.functions.dom import filled_text, first, once, stock_of
from tallymart.functions.money import currency_code, parse_decimal

# Keys below which products stand, keys of trade numbers, and types of pages that list products.
NESTED = ("offers", "itemListElement", "mainEntity", "isVariantOf")
GTINS = ("gtin13", "gtin14", "gtin12", "gtin8", "gtin")
LISTINGS = ("CollectionPage", "ItemList", "SearchResultsPage")

_NONE = "cast(array() as array<variant>)"


def at(v: Column, key: str) -> Column:
    """A field of an object; null for anything else."""
    return F.try_variant_get(v, f'$["{key}"]', "variant")


def items(v: Column) -> Column:
    """The items of a list; none for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.expr(_NONE))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def head(v: Column) -> Column:
    """The first item of a list; anything else as it is."""
    return F.when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), first(items(v))).otherwise(v)


def word(v: Column) -> Column:
    """The text of a value: of a list its first item, of an object its url, name or id; null if empty."""
    one = head(v)
    plain = lambda x: filled_text(F.try_variant_get(x, "$", "string"))
    return F.left(F.when(is_object(one), F.coalesce(*(plain(at(one, k)) for k in ("url", "name", "@id")))).otherwise(plain(one)), F.lit(1024))


def type_of(v: Column) -> Column:
    """The type of an object, a list of them as JSON; empty if there is none."""
    return F.coalesce(F.try_variant_get(v, '$["@type"]', "string"), F.try_variant_get(v, "$.type", "string"), F.lit(""))


def has_type(v: Column, name: str) -> Column:
    """Whether a type of an object holds ``name``, in any case."""
    return F.lower(type_of(v)).contains(name.lower())


def children(v: Column) -> Column:
    """What the walk meets next below a value: a list's items, or an object's graph and then what its ``NESTED`` keys hold."""
    below = [items(at(v, "@graph"))] + [F.when(at(v, k).isNotNull(), F.array(at(v, k))).otherwise(F.expr(_NONE)) for k in NESTED]
    return F.filter(F.concat(items(v), *below), lambda x: is_object(x) | (F.size(items(x)) > 0))


def objects(scripts: Column) -> Column:
    """All objects that the walk meets in some scripts, depth first in document order.

    The walk keeps a stack in an aggregate with one step for each bracket of the
    scripts, which are never fewer than the values to visit. Scripts that aren't
    JSON are left out.
    """
    start = F.filter(F.transform(scripts, lambda s: F.try_parse_json(s)), lambda v: v.isNotNull())
    whole = F.array_join(scripts, "")
    steps = F.length(whole) - F.length(F.replace(F.replace(whole, F.lit("{"), F.lit("")), F.lit("["), F.lit("")))

    def step(acc: Column, _: Column) -> Column:
        def visited(v: Column) -> Column:
            rest = F.concat(children(v), F.slice(acc["stack"], F.lit(2), F.size(acc["stack"])))
            return F.struct(rest.alias("stack"), F.when(is_object(v), F.concat(acc["seen"], F.array(v))).otherwise(acc["seen"]).alias("seen"))

        return F.when(F.size(acc["stack"]) == 0, acc).otherwise(once(acc["stack"][0], visited))

    return F.aggregate(F.sequence(F.lit(0), steps), F.struct(start.alias("stack"), F.expr(_NONE).alias("seen")), step, lambda acc: acc["seen"])


def availability(v: Column) -> Column:
    """A stock state from schema.org's words, else from those of pages."""
    raw = F.try_variant_get(v, "$", "string")
    compact = F.regexp_replace(F.lower(raw), "[^a-zа-я0-9]+", "")
    return F.when(compact.contains("instock"), "in_stock").when(compact.contains("outofstock") | compact.contains("soldout"), "out_of_stock").when(compact.contains("preorder"), "preorder").otherwise(stock_of(F.replace(raw, F.lit("/"), F.lit(" "))))


def product(scripts: Column) -> Column:
    """(title, brand, ean, mpn, sku, model, price, currency, availability, image, listing) of the first product.

    Of several offers, prices or brands the first counts; a price that is empty
    or 0 gives way to the lowest one. The trade number is the first valid one of
    any key. ``listing``: no product, but the type of a page that lists some.
    """

    def fields_of(seen: Column) -> Column:
        p = first(F.filter(seen, lambda v: has_type(v, "Product")))
        lists = F.exists(seen, lambda v: has_type(v, LISTINGS[0]) | has_type(v, LISTINGS[1]) | has_type(v, LISTINGS[2]))
        return once(p, lambda v: told(v, v.isNull() & lists))

    def told(p: Column, listing: Column) -> Column:
        offer = head(at(p, "offers"))
        said = lambda k: F.nullif(filled_text(F.try_variant_get(head(at(offer, k)), "$", "string")), F.lit("0"))
        price = parse_decimal(F.coalesce(said("price"), said("lowPrice")))
        brand = F.when(is_object(head(at(p, "brand"))), word(at(head(at(p, "brand")), "name"))).otherwise(word(at(p, "brand")))
        numbers = F.array(*(F.regexp_replace(word(at(p, k)), r"(?U)\D", "") for k in GTINS))
        return F.struct(
            word(at(p, "name")).alias("title"), brand.alias("brand"), first(F.filter(numbers, gtin_valid)).alias("ean"), word(at(p, "mpn")).alias("mpn"),
            word(at(p, "sku")).alias("sku"), word(at(p, "model")).alias("model"), price.cast("double").alias("price"), currency_code(said("priceCurrency")).alias("currency"),
            availability(at(offer, "availability")).alias("availability"), word(at(p, "image")).alias("image"), listing.alias("listing"),
        )

    return once(objects(scripts), fields_of)
