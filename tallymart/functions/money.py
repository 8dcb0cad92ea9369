"""Amounts and currencies. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CURRENCIES = {"лв": "BGN", "bgn": "BGN", "€": "EUR", "eur": "EUR", "$": "USD", "usd": "USD", "£": "GBP", "gbp": "GBP"}
BGN_PER_EUR = "1.95583"
INSANE = 10_000_000_000


def _number(whole: Column, fraction: Column) -> Column:
    return F.concat(F.regexp_replace(whole, "[.,]", ""), F.lit("."), fraction).try_cast("decimal(18,4)")


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, "[.,]", "").try_cast("decimal(18,4)")


def parse_decimal(x: Column) -> Column:
    """The amount that a text names, by guessing which separator is the decimal one.

    With both kinds, the last is decimal. With one kind, three digits after the
    last mean thousands; any other number of digits means decimals.
    """
    t = F.regexp_replace(F.regexp_extract(x, r"(\d[\d\s.,]*)", 1), r"(?U)\s+", "")
    whole, fraction = F.regexp_extract(t, r"^(.*)[.,](\d*)$", 1), F.regexp_extract(t, r"^(.*)[.,](\d*)$", 2)
    mixed = t.contains(",") & t.contains(".")
    separated = t.contains(",") | t.contains(".")
    value = F.when(separated & (mixed | (F.length(fraction) != 3)), _number(whole, fraction)).otherwise(_plain(t))
    return F.when(t != "", value)


def parse_leva(x: Column) -> Column:
    """The amount of a fragment: a lone separator with at most two digits after it is decimal, the last of two kinds too."""
    t = F.regexp_replace(x, r"(?U)\s+", "")
    whole, fraction = F.regexp_extract(t, r"^(.*)[.,](\d*)$", 1), F.regexp_extract(t, r"^(.*)[.,](\d*)$", 2)
    mixed = t.contains(",") & t.contains(".")
    lone = F.length(F.regexp_replace(t, "[^.,]", "")) == 1
    value = F.when(mixed | (lone & (F.length(fraction) <= 2) & (fraction != "")), _number(whole, fraction)).otherwise(_plain(t))
    return F.when(t.rlike(r"^[\d.,]+$"), value)


def leva_amounts(x: Column) -> Column:
    """All amounts in a text that are followed by лв or BGN."""
    found = F.regexp_extract_all(x, F.lit(r"(?iu)([\d\s][\d\s.,]*)\s*(?:лв\.?|BGN)(?![\wа-я])"), F.lit(1))
    return F.filter(F.transform(found, parse_leva), lambda v: v.isNotNull())


def likely_prices(amounts: Column) -> Column:
    """(price, old, promo) from candidate amounts: the least and, if another is there, the greatest."""
    sane = F.array_sort(F.array_distinct(F.filter(amounts, lambda v: v.between(F.lit("0.01").cast("decimal(18,4)"), F.lit("999999.99").cast("decimal(18,4)")))))
    low, high = F.get(sane, F.lit(0)), F.get(sane, F.size(sane) - 1)
    several = F.size(sane) > 1
    return F.struct(low.alias("price"), F.when(several, high).alias("old"), F.when(several, low).alias("promo"))


def currency_code(x: Column) -> Column:
    """The code for a symbol or word; another text of three letters is taken as a code."""
    raw = F.regexp_replace(F.lower(F.trim(x)), r"\.", "")
    known = F.create_map(*(F.lit(v) for kv in CURRENCIES.items() for v in kv))
    return F.coalesce(F.try_element_at(known, raw), F.when(F.length(raw) == 3, F.upper(raw)))


def currency_satisfies(currency: Column, preference: Column) -> Column:
    """Whether a currency serves a preference: none is set, it is the same, or both are of BGN and EUR."""
    pair = currency.isin("BGN", "EUR") & preference.isin("BGN", "EUR")
    return preference.isNull() | F.coalesce((currency == preference) | pair, F.lit(False))


def bgn_to_eur(x: Column) -> Column:
    """Leva in euro at the fixed rate, half up to two places."""
    return F.round(x.cast("decimal(18,4)") / F.lit(BGN_PER_EUR).cast("decimal(10,5)"), 2).cast("decimal(14,2)")


def sane_price(x: Column) -> Column:
    """Null from ten thousand million on."""
    return F.when(F.abs(x) < INSANE, x)


def campaign_price(price: Column, percent: Column) -> Column:
    """The price less a percentage, to two places."""
    return F.round(price * (100 - percent) / 100, 2)


def regular_final(regular: Column, final: Column) -> Column:
    """(price, old, promo) from a regular and a final price."""
    lower = final < regular
    return F.struct(F.coalesce(regular, final).alias("price"), F.when(lower, regular).alias("old"), F.when(lower, final).alias("promo"))


def price_candidates(x: Column) -> Column:
    """All (amount, currency) in a text, amounts above 0; the currency stands before the amount or after it."""
    unit = r"(?:лв\.?|BGN|EUR|€|USD|\$|GBP|£)"
    found = F.regexp_extract_all(x, F.lit(rf"(?iu)({unit}\s*\d[\d\s.,]*|\d[\d\s.,]*\s*{unit})"), F.lit(1))
    one = lambda t: F.struct(parse_decimal(t).alias("amount"), currency_code(F.regexp_replace(t, r"[\d\s.,]", "")).alias("currency"))
    return F.filter(F.transform(found, one), lambda c: c["amount"] > 0)


def in_euro(x: Column, currency: Column) -> Column:
    """The amount in euro if it is in leva, else as it is."""
    return F.when(currency == "BGN", bgn_to_eur(x)).otherwise(x)


def promo_of(price: Column, old: Column) -> Column:
    """The price, if an old one above it is known."""
    return F.when(old > price, price)


def variant_price(price: Column, regular: Column) -> Column:
    """(price, old, promo) of a variant: below its regular price the regular one is shown and the price is the promotion."""
    lower = price < regular
    return F.struct(F.when(lower, regular).otherwise(price).alias("price"), F.when(lower, regular).alias("old"), F.when(lower, price).alias("promo"))
