"""Fields of observations and payloads: states, errors, specifications, nested JSON. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymart.functions.codes import norm, stripped

# Patterns of failure messages and their codes, in order; words of specification labels and their keys, in order.
ERRORS = (("price_missing", "price_not_found"), ("status_404| 404|not found", "product_not_found"), ("status_429|too many requests|rate_limited", "rate_limited"), ("http_parse", "http_parse_failed"), ("http_blocked", "http_blocked"), ("timeout", "playwright_timeout"), ("connection|network", "network_error"), ("playwright", "playwright_timeout"))
BLOCKS = (("blocked_challenge:", "challenge_or_captcha"), ("status_403:", "http_403_forbidden"), ("status_429:", "rate_limited"), ("status_401:", "access_denied"))
LABELS = (("ean|баркод|barcode", "ean"), ("цвят|colou?r", "color"), ("ram|оперативна памет", "memory"), ("storage|вграден|капацитет|памет", "storage"), ("марка|brand|производител", "brand"), ("модел|model", "model"), ("код на производител|mpn|part number", "manufacturer_code"))


def _first(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The value of the first rule whose pattern occurs; null if none does."""
    return F.coalesce(*(F.when(x.rlike(pattern), F.lit(value)) for pattern, value in rules))


def error_class(message: Column, status: Column | None = None) -> Column:
    """The stable code of a failure, by its HTTP status where that decides, else by its message."""
    by_text = F.coalesce(_first(F.lower(F.coalesce(message, F.lit(""))), ERRORS), F.lit("unknown"))
    if status is None:
        return by_text
    return F.when(status == 404, "product_not_found").when(status == 429, "rate_limited").when(status.isin(401, 403), "http_blocked").otherwise(by_text)


def block_reason(errors: Column) -> Column:
    """Why public discovery was refused: a challenge before 403, that before 429, that before 401."""
    return _first(errors, BLOCKS)


def availability(x: Column) -> Column:
    """in_stock, out_of_stock or preorder from a shop's words."""
    return _first(F.lower(x), (("in stock|available|наличност", "in_stock"), ("out of stock|изчерпан", "out_of_stock"), ("pre-?order", "preorder")))


def blocked_page(status: Column, body: Column) -> Column:
    """Whether a response is a refusal: its status, or a challenge in the first 5000 characters."""
    return F.coalesce(status.isin(401, 403, 429) | (status >= 500), F.lit(False)) | F.coalesce(F.lower(F.left(body, F.lit(5000))).rlike("captcha|checking your browser"), F.lit(False))


def needs_fallback(failed: Column, price: Column, blocked: Column) -> Column:
    """Whether the browser must be asked: a failure, no price, or a blocked page."""
    return F.coalesce(failed, F.lit(True)) | price.isNull() | F.coalesce(blocked, F.lit(False))


def product_code(x: Column) -> Column:
    """The code after a label."""
    sku = F.nullif(F.regexp_extract(x, r"(?iu)\bsku\s*[:#]?\s*([\w-]+)", 1), F.lit(""))
    return F.coalesce(sku, F.nullif(F.regexp_extract(x, r"(?iu)код[^\d]*([\w-]*\d[\w-]*)", 1), F.lit("")))


def layer(x: Column) -> Column:
    """The fetch layer, the browser where none is named."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("playwright"))


def stock_code(x: Column) -> Column:
    """The stock state of a product API."""
    return F.when(x == "inStock", "in_stock").when(x == "outOfStock", "out_of_stock").when(x == "lowStock", "low_stock").otherwise(F.lower(x))


def spec(x: Column, key: str) -> Column:
    """A specification of a JSON object, at the top or among its attributes."""
    return F.coalesce(*(F.nullif(F.get_json_object(x, p), F.lit("")) for p in (f"$.{key}", f"$.attributes.{key}")))


def image(x: Column) -> Column:
    """The URL of the product image, else of the zoomed one, else of the primary one."""
    images = F.from_json(x, "array<struct<format:string,imageType:string,url:string>>")
    of = lambda test: F.get(F.filter(images, test), F.lit(0))["url"]
    return F.coalesce(of(lambda i: i["format"] == "product"), of(lambda i: i["format"] == "zoom"), of(lambda i: i["imageType"] == "PRIMARY"))


def breadcrumb(x: Column) -> Column:
    """Names of a product API's trail, the product itself left out."""
    steps = F.from_json(x, "array<struct<name:string,url:string>>")
    return F.transform(F.filter(steps, lambda e: ~F.coalesce(e["url"].contains("/p/"), F.lit(False))), lambda e: e["name"])


def crumb_names(x: Column) -> Column:
    """Names of a trail whose steps are texts or objects; others and empty ones are left out."""
    items = F.from_json(x, "array<string>")
    name = lambda i: F.when(i.startswith("{"), F.coalesce(F.get_json_object(i, "$.name"), F.get_json_object(i, "$.title"))).when(~i.rlike(r"^[\d.\[{]"), i)
    return F.filter(F.transform(F.transform(items, name), stripped), lambda n: n != "")


def candidates(x: Column) -> Column:
    """Stored match candidates; items without a product are skipped."""
    items = F.from_json(x, "array<string>")
    parsed = F.transform(F.filter(items, lambda i: i.startswith("{")), lambda i: F.from_json(i, "struct<product_id:string,sku:string,name:string,match_score:string,match_method:string>"))
    return F.filter(parsed, lambda c: c["product_id"].isNotNull())


def classifications(x: Column) -> Column:
    """Groups of features as ``group: feature=value, value``, joined by semicolons."""
    groups = F.from_json(x, "array<struct<name:string,features:array<struct<name:string,featureValues:array<struct<value:string>>>>>>")
    pairs = F.flatten(F.transform(groups, lambda g: F.transform(g["features"], lambda f: F.concat(g["name"], F.lit(": "), f["name"], F.lit("="), F.array_join(F.transform(f["featureValues"], lambda v: v["value"]), ", ")))))
    return F.array_join(pairs, ";")


def flat_attributes(x: Column) -> Column:
    """Attributes with a value as ``code=value``, joined by semicolons."""
    return F.array_join(F.transform(F.filter(F.from_json(x, "array<struct<code:string,value:string>>"), lambda e: e["value"].isNotNull()), lambda e: F.concat(e["code"], F.lit("="), e["value"])), ";")


def merged(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def spec_label(x: Column) -> Column:
    """The key that a specification's label stands for; null for others."""
    return _first(norm(x), LABELS)


def codes_by_priority(attributes: Column, names: tuple[str, ...], most: int = 2) -> Column:
    """The first values of the named attributes that aren't empty, none of them twice."""
    return F.slice(F.array_distinct(F.filter(F.array(*(attributes[n] for n in names)), lambda v: v.isNotNull() & (v != ""))), 1, most)


def path_text(names: Column) -> Column:
    return F.array_join(names, " > ")


def attributes_text(attributes: Column) -> Column:
    """``key: value`` of a map in the order of keys, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def first_text(*values: Column) -> Column:
    """The first value that isn't empty, trimmed."""
    return F.coalesce(*(F.nullif(stripped(v), F.lit("")) for v in values))


def minutes_left(remaining: Column, per_minute: Column) -> Column:
    """Minutes until the rest is done, rounded up; null at no progress."""
    return F.ceil(F.try_divide(remaining.cast("double"), per_minute.cast("double"))).cast("long")


def stalled(progress_at: Column, now: Column, seconds: int = 300) -> Column:
    """Whether a run's last progress is older than that."""
    return progress_at < now - F.expr(f"INTERVAL {seconds} SECONDS")
