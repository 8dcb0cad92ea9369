"""Identifiers: codes, EAN and GTIN numbers, placeholders, tokens. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PLACEHOLDERS = ("-", "--", "—", "–", ".", "n/a", "na", "none", "null", "x")
GTIN_LENGTHS = (8, 12, 13, 14)
TYPE_WORDS = (
    "пъзел пъзели конструктор конструктори фигура фигурка фигури кукла кукли книга книжка книжки часовник игра игри "
    "раница чанта портмоне несесер колело тротинетка скутер плюшена плюшено плюш топка робот дрон количка влак "
    "самолет костюм рокля панталон тениска блуза яке пижама суитшърт клин обувки маратонки чехли сандали шапка "
    "чорапи бельо боди гащеризон парфюм крем шампоан лосион гел спирала червило балсам четка лаптоп телефон "
    "смартфон таблет монитор телевизор слушалки тонколона мишка клавиатура принтер рутер камера хладилник пералня "
    "фурна микровълнова прахосмукачка ютия кафемашина климатик "
    "puzzle watch figure doll book backpack scooter laptop phone tablet headphones keyboard mouse monitor plush"
).split()


def stripped(x: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def norm(x: Column) -> Column:
    """Trimmed, lower case, null as empty."""
    return F.lower(stripped(F.coalesce(x, F.lit(""))))


def norm_code(x: Column) -> Column:
    """A code without white space and ``- _ . /``."""
    return F.regexp_replace(norm(x), r"(?U)[\s\-_./]", "")


def norm_ean(x: Column) -> Column:
    """Digits only; null below eight of them."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(digits) >= 8, digits)


def spec_ean(x: Column) -> Column:
    """Digits of a specification value; null unless there are eight to fourteen."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(digits).between(8, 14), digits)


def first_group(x: Column, pattern: str) -> Column:
    """The first group of a pattern in a text; null where it doesn't occur."""
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


#: Words that stand before a colour.
COLOR_LABELS = "цвят|цвета|нюанс|оттенък|colou?r|shade|nuance|tone|tint"


def variant_color(x: Column) -> Column:
    """What is left of a variant's text without its size and a label before the colour."""
    rest = F.regexp_replace(x, r"(?iu)\d+(?:[.,]\d+)?\s*(?:ml|мл|kg|кг|oz|гр|g|l|л)(?![\wа-я])\.?", "")
    return F.nullif(stripped(F.regexp_replace(stripped(rest), rf"(?iu)^(?:{COLOR_LABELS})(?![\wа-я])[\s:]*|^[\s,.–—-]+|[\s,.–—-]+$", "")), F.lit(""))


def category_name(x: Column) -> Column:
    """Control characters as blanks, white space as one blank, at most 512 characters."""
    return F.nullif(F.left(stripped(F.regexp_replace(x, r"(?U)[\s\p{Cntrl}]+", " ")), F.lit(512)), F.lit(""))


def strip_html(x: Column) -> Column:
    """Text without tags, the common character references decoded, white space as one blank."""
    text = F.regexp_replace(x, r"<[^>]+>", " ")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(c))
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def gtin_valid(x: Column) -> Column:
    """Whether a code has a GTIN length, not one digit alone, and the right check digit."""
    shape = x.rlike(r"^(\d{8}|\d{12,14})$") & ~x.rlike(r"^(\d)\1*$")
    # weights 3 and 1 alternate from the digit before the check digit
    digits = F.transform(F.split(F.reverse(x), ""), lambda c: F.expr("0") + F.coalesce(c.try_cast("int"), F.lit(0)))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 1, d * 3).otherwise(d)), F.lit(0), lambda a, d: a + d)
    return F.coalesce(shape & (total % 10 == 0), F.lit(False))


def placeholder(x: Column) -> Column:
    """Null where the cell holds nothing or only stands for nothing."""
    s = stripped(x)
    return F.when((s == "") | F.lower(s).isin(*PLACEHOLDERS), F.lit(None).cast("string")).otherwise(s)


def header_name(x: Column) -> Column:
    """A column header: trimmed, lower case, white space as one underscore."""
    return F.regexp_replace(norm(x), r"(?U)\s+", "_")


def cell_code(x: Column) -> Column:
    """A code from a spreadsheet cell as text: 42.0 is 42."""
    return placeholder(F.regexp_replace(x, r"^(\d+)\.0+$", "$1"))


def search_tokens(x: Column) -> Column:
    """Distinct words of three letters or digits and more, Latin or Cyrillic."""
    return F.array_distinct(F.regexp_extract_all(norm(x), F.lit(r"[a-z0-9а-я]{3,}"), F.lit(0)))


def word_tokens(x: Column) -> Column:
    """Distinct runs of Latin letters and digits."""
    return F.array_distinct(F.regexp_extract_all(norm(x), F.lit(r"[a-z0-9]+"), F.lit(0)))


def type_tokens(x: Column) -> Column:
    """Words of a text that name a kind of product."""
    words = F.regexp_extract_all(norm(x), F.lit(r"[a-zа-я]+"), F.lit(0))
    return F.array_intersect(words, F.array(*map(F.lit, TYPE_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def size_text(x: Column) -> Column:
    """The first amount with a unit, in upper case and Latin units."""
    found = F.upper(F.regexp_extract(x, r"(?iu)(?<![\w])(\d+(?:[.,]\d+)?\s*(?:ml|мл|kg|кг|oz|гр|g|l|л))(?![\wа-я])", 1))
    latin = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(found, r"(?U)\s+", ""), "МЛ$", "ML"), "КГ$", "KG"), "ГР$", "G"), "Л$", "L")
    return F.nullif(latin, F.lit(""))


def storage_size(x: Column) -> Column:
    """The number before ``gb``, else that before ``tb``."""
    low = F.lower(x)
    return F.coalesce(F.nullif(F.regexp_extract(low, r"(\d+)\s*gb", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"(\d+)\s*tb", 1), F.lit("")))


def memory_size(x: Column) -> Column:
    """The number before ``gb ram``, else that before ``gb ddr``."""
    low = F.lower(x)
    return F.coalesce(F.nullif(F.regexp_extract(low, r"(\d+)\s*gb\s*ram", 1), F.lit("")), F.nullif(F.regexp_extract(low, r"(\d+)\s*gb\s*ddr", 1), F.lit("")))


def _named(specs: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(norm(F.try_element_at(specs, F.lit(k))), F.lit("")) for k in keys))


def color_of(specs: Column) -> Column:
    """The colour among the specifications, by its English or Bulgarian key."""
    return _named(specs, ("color", "colour", "цвят"))


def storage_of(specs: Column, blob: Column) -> Column:
    """The storage among the specifications, else the first size in the text."""
    return F.coalesce(_named(specs, ("storage", "памет", "capacity")), storage_size(blob))


def memory_of(specs: Column, blob: Column) -> Column:
    """The memory among the specifications, else a size before RAM or DDR in the text."""
    return F.coalesce(_named(specs, ("memory", "ram", "оперативна памет")), memory_size(blob))
