"""Fields out of pages, sitemaps and payloads, where native functions suffice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymart.functions.codes import gtin_valid, size_text, strip_html, variant_color
from tallymart.functions.json_ld import product
from tallymart.functions.money import currency_code, parse_decimal, price_candidates
from tallymart.functions.urls import is_sitemap


def sitemap_locations(body: Column) -> Column:
    """All locations of a sitemap, sitemap index, RSS or Atom feed, or of a plain list with a URL on each line."""
    xml = F.regexp_replace(body, r"\sxmlns(?::\w+)?=\"[^\"]*\"", "")
    found = lambda path: F.transform(F.xpath(xml, F.lit(path)), lambda u: F.trim(u))
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda u: F.trim(u)), lambda u: u.rlike("^https?://"))
    return (
        F.when(body.rlike(r"<(?:urlset|sitemapindex)\b"), found("//loc/text()"))
        .when(body.rlike(r"<rss\b"), found("//item/link/text()"))
        .when(body.rlike(r"<feed\b"), found("//entry/link/@href"))
        .otherwise(F.coalesce(lines, F.array().cast("array<string>")))
    )


def sitemap_parts(body: Column) -> Column:
    """(pages, nested): what a sitemap names, sitemaps apart from pages.

    All of an index is nested, and so is what stands in a ``sitemap`` element or
    looks like a sitemap; feeds name pages only. Anything that isn't XML is read
    as a list with a URL on each line.
    """
    root = F.lower(F.regexp_extract(body, r"(?is)<(?:\w+:)?(urlset|sitemapindex|rss|feed)\b", 1))
    clean = lambda u: F.replace(F.trim(F.regexp_replace(u, r"(?s)^\s*<!\[CDATA\[|\]\]>\s*$", "")), F.lit("&amp;"), F.lit("&"))
    locs = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?is)<(?:\w+:)?loc\b[^>]*>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1)), clean)
    held = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<(?:\w+:)?sitemap\b[^>]*>(.*?)</(?:\w+:)?sitemap>"), F.lit(1)), locs))
    none = F.array().cast("array<string>")
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda u: F.trim(u)), lambda u: u.rlike("^https?://"))
    links = F.transform(F.concat(F.regexp_extract_all(body, F.lit(r"(?is)<item\b.*?<link\b[^>]*>\s*(https?://.*?)\s*</link>"), F.lit(1)), F.regexp_extract_all(body, F.lit(r"(?is)<entry\b.*?<link\b[^>]*href=[\"'](https?://[^\"']*)"), F.lit(1))), clean)
    named = F.when(root.isin("rss", "feed"), none).when(root != "", locs(body)).otherwise(F.coalesce(lines, none))
    whole = F.filter(F.coalesce(named, none), lambda u: u != "")
    nests = lambda u: (root == "sitemapindex") | F.array_contains(held, u) | is_sitemap(u)
    pages = F.when(root.isin("rss", "feed"), links).otherwise(F.filter(whole, lambda u: ~F.coalesce(nests(u), F.lit(False))))
    return F.struct(F.coalesce(pages, none).alias("pages"), F.filter(whole, lambda u: F.coalesce(nests(u), F.lit(False))).alias("nested"))


def is_sitemap_index(xml: Column) -> Column:
    return xml.contains("<sitemapindex")


def json_ld(html: Column) -> Column:
    """The bodies of the JSON-LD scripts of a page."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))


def json_ld_product(html: Column) -> Column:
    """The fields of the first product in a page's JSON-LD."""
    return product(json_ld(html))


def event_price(html: Column) -> Column:
    """The price in the 1500 characters after ``view_item``."""
    near = F.regexp_extract(html, r"(?s)view_item(.{0,1500})", 1)
    return parse_decimal(F.nullif(F.regexp_extract(near, r"[\"']price[\"']\s*:\s*[\"']?([\d.,]+)", 1), F.lit("")))


def labelled_ean(html: Column) -> Column:
    """The first valid number after an EAN, GTIN or barcode label, in markup, JSON or text."""
    found = F.regexp_extract_all(html, F.lit(r"(?iu)(?:gtin\d{0,2}|ean|barcode|баркод)[\"'\s:=>-]*(?:content=[\"'])?(\d{8,14})(?!\d)"), F.lit(1))
    return F.get(F.filter(found, gtin_valid), F.lit(0))


def seller(html: Column) -> Column:
    """Who offers the item, by the label before it."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?iu)(?:sold by|продаван[оа]? от)\s*:?\s*([^<\n]{1,255})", 1)), F.lit(""))


def feed_entries(item: Column) -> Column:
    """Rows (sku, url, price, ean) of a feed item: one for each variant, or one for the item.

    Comma-joined barcodes go to the variants by position if there are as many.
    """
    schema = "struct<sku:string,url_key:string,price:double,barcodes:string,variants:array<struct<sku:string,price:double>>>"
    i = F.from_json(item, schema)
    codes = F.split(F.coalesce(i["barcodes"], F.lit("")), r"\s*,\s*")
    fits = F.size(codes) == F.size(i["variants"])
    many = F.transform(i["variants"], lambda v, k: F.struct(v["sku"].alias("sku"), i["url_key"].alias("url"), v["price"].alias("price"), F.when(fits, F.get(codes, k)).alias("ean")))
    one = F.array(F.struct(i["sku"].alias("sku"), i["url_key"].alias("url"), i["price"].alias("price"), F.nullif(F.get(codes, F.lit(0)), F.lit("")).alias("ean")))
    return F.when(F.coalesce(F.size(i["variants"]), F.lit(0)) > 0, many).otherwise(one)


def title_of(html: Column) -> Column:
    """The Open Graph title, else the first heading, else the page's title."""
    by = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    return F.coalesce(by(r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"'), by(r"(?is)<h1[^>]*>(.*?)</h1>"), by(r"(?is)<title[^>]*>(.*?)</title>"))


def image_of(html: Column) -> Column:
    """The Open Graph image, else the first one of the page."""
    by = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    return F.coalesce(by(r'(?is)<meta[^>]*property="og:image"[^>]*content="([^"]*)"'), by(r'(?is)<img[^>]*src="([^"]*)"'))


def mpn_of(html: Column) -> Column:
    """The manufacturer's number of the JSON-LD product, else that after a label."""
    return F.coalesce(json_ld_product(html)["mpn"], F.nullif(F.regexp_extract(html, r"(?iu)(?:mpn|part number|код на производител)[\"'\s:>-]*([\w./-]*\d[\w./-]*)", 1), F.lit("")))


def links(html: Column, base: Column) -> Column:
    """Absolute URLs of all links of a page, in order, each once."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a[^>]*href="([^"#][^"]*)"'), F.lit(1))
    root = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    return F.array_distinct(F.transform(found, lambda u: F.when(u.startswith("/"), F.concat(root, u)).otherwise(u)))


def next_page(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'(?is)<a[^>]*rel="next"[^>]*href="([^"]*)"', 1), F.lit(""))


def filled(parsed: Column, found: Column, names: tuple[str, ...]) -> Column:
    """The fields of ``parsed``; what is null or unknown there comes from ``found``."""
    return F.struct(*(F.coalesce(F.when(parsed[n].cast("string") != "unknown", parsed[n]), found[n]).alias(n) for n in names))


def observation_of_entry(entry: Column, title: Column) -> Column:
    """(sku, url, price, brand, status) of a feed entry: the brand is the title's first word; no price is a failure."""
    brand = F.nullif(F.split_part(F.trim(title), F.lit(" "), F.lit(1)), F.lit(""))
    status = F.when(entry["price"].isNull(), "failed").otherwise("success")
    return F.struct(entry["sku"].alias("sku"), entry["url"].alias("url"), entry["price"].alias("price"), brand.alias("brand"), status.alias("status"))


def json_urls(item: Column) -> Column:
    """The values of URL, URL key and handle fields anywhere in a JSON text, each once."""
    return F.array_distinct(F.regexp_extract_all(item, F.lit(r'"(?:url_key|url|handle|canonical_url|href)"\s*:\s*"([^"]+)"'), F.lit(1)))


def own_variant(variants: Column, own: Column, price: Column) -> Column:
    """The variant (sku, price) that a page shows: by its own id, else by an equal price, else the cheapest; without any price the first."""
    first = lambda a: F.get(a, F.lit(0))
    priced = F.filter(variants, lambda v: v["price"].isNotNull())
    cheapest = first(F.array_sort(F.transform(priced, lambda v, k: F.struct(v["price"].alias("price"), k.alias("k"), v["sku"].alias("sku")))))
    return F.coalesce(first(F.filter(variants, lambda v: v["sku"] == own)), first(F.filter(variants, lambda v: v["price"] == price)), F.when(cheapest.isNotNull(), F.struct(cheapest["sku"].alias("sku"), cheapest["price"].alias("price"))), first(variants))


#: What marks a variant among the objects that a page embeds, and the classes of a selected option.
VARIANT_MARK = '"__typename":"CatalogVariant"'
SELECTED = r"selected|active|border-\[#9bdcd2\]"
_VARIANT = "struct<url:string,name:string,additionalInfo:string,productCode:string,orderCode:string,eanCode:string,colors:array<string>,parameters:struct<amount:string,unit:string>,price:struct<value:string,currency:string>,originalPrice:struct<value:string,type:string,currency:string>>"


def embedded_variants(html: Column, base: Column) -> Column:
    """Variants that a page embeds as JSON objects, in page order, repeats of a URL included.

    An object begins at the last brace before its mark; the JSON reader stops where it ends. Objects without a URL and broken ones
    give nothing. (url, size, color, price, regular, currency, ean, manufacturer_code, shop_code, title); a recommended original
    price is the regular one, other original prices aren't.
    """
    parts = F.split(html, VARIANT_MARK)
    n = F.size(parts)
    texts = F.transform(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda p, k: F.when(p.contains("{"), F.concat(F.lit("{"), F.substring_index(p, "{", -1), F.lit(VARIANT_MARK), F.array_join(F.slice(parts, k + 2, n), VARIANT_MARK))))
    root = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    nodes = F.filter(F.transform(texts, lambda t: F.from_json(t, _VARIANT)), lambda v: F.trim(v["url"]) != "")

    def fields_of(v: Column) -> Column:
        u = F.trim(v["url"])
        url = F.when(u.rlike("^https?://"), u).otherwise(F.concat(root, F.lit("/"), F.regexp_replace(u, "^/+", "")))
        size = F.coalesce(size_text(F.concat_ws(" ", v["parameters"]["amount"], v["parameters"]["unit"])), size_text(v["additionalInfo"]))
        color = F.coalesce(variant_color(v["additionalInfo"]), F.nullif(F.trim(F.get(v["colors"], F.lit(0))), F.lit("")))
        regular = F.when(v["originalPrice"]["type"] == "Recommended", parse_decimal(v["originalPrice"]["value"]))
        digits = F.regexp_replace(v["eanCode"], r"\D", "")
        return F.struct(
            url.alias("url"), size.alias("size"), F.left(color, F.lit(120)).alias("color"), parse_decimal(v["price"]["value"]).cast("double").alias("price"), F.when(regular > 0, regular).cast("double").alias("regular"),
            currency_code(F.coalesce(v["price"]["currency"], v["originalPrice"]["currency"])).alias("currency"), F.when(gtin_valid(digits), digits).alias("ean"),
            F.nullif(F.trim(v["productCode"]), F.lit("")).alias("manufacturer_code"), F.nullif(F.trim(v["orderCode"]), F.lit("")).alias("shop_code"), F.nullif(F.trim(v["name"]), F.lit("")).alias("title"),
        )

    return F.transform(nodes, fields_of)


def swatch(html: Column) -> Column:
    """(size, price, promo, currency) of the selected option of a page's size swatches.

    The first price in euro is the price, the first lower one after it the promotion. Where no selected option names a size or a
    price, the swatch's label gives the size alone. Options hold no blocks of their own.
    """
    root = r"(?is)<div[^>]*class=\"(?=[^\"]*size)[^\"]*swatch-attribute(?=[\s\"])"
    areas = F.slice(F.split(html, root), F.lit(2), F.greatest(F.size(F.split(html, root)) - 1, F.lit(0)))
    option = lambda a: strip_html(F.regexp_extract(a, rf"(?is)swatch-attribute-options.*?<div[^>]*class=\"[^\"]*(?:{SELECTED})[^\"]*\"[^>]*>(.*?)</div>", 1))
    euro = lambda t: F.transform(F.filter(price_candidates(t), lambda c: c["currency"] == "EUR"), lambda c: c["amount"].cast("double"))
    found = F.transform(F.transform(areas, option), lambda t: F.struct(size_text(t).alias("size"), euro(t).alias("euro")))
    one = F.get(F.filter(found, lambda o: o["size"].isNotNull() | (F.size(o["euro"]) > 0)), F.lit(0))
    price = F.get(one["euro"], F.lit(0))
    label = F.get(F.filter(F.transform(areas, lambda a: size_text(strip_html(F.regexp_extract(a, r"(?is)product-option-label.*?<span[^>]*\bx-text\b[^>]*>(.*?)</span>", 1)))), lambda s: s.isNotNull()), F.lit(0))
    promo = F.get(F.filter(F.slice(one["euro"], F.lit(2), F.greatest(F.size(one["euro"]), F.lit(0))), lambda p: p < price), F.lit(0))
    return F.struct(F.when(one.isNotNull(), one["size"]).otherwise(label).alias("size"), price.alias("price"), promo.alias("promo"), F.when(price.isNotNull(), "EUR").alias("currency"))
