"""Operators on small tables: cycles, nulls, repeats, empty tables, files."""

from pyspark.sql import functions as F

from tallymart.functions import codes, fields, markup, money, urls
from tallymart.operators import health, listings as L, ranking, trees, upserts
from tallymart.sources import workbook, xlsx_source

TREE = "id long, parent_id long, name string, level int"


def test_paths_of_deep_trees_cycles_and_orphans(spark):
    rows = [(k, k - 1 if k > 1 else None, f"n{k}", k) for k in range(1, 12)] + [(20, 21, "a", 0), (21, 20, "b", 0), (22, 21, "c", 0), (30, 99, "x", 0), (40, 40, "self", 0)]
    got = {r["id"]: r["path"] for r in trees.paths(spark.createDataFrame(rows, TREE)).collect()}
    assert got[11] == " > ".join(f"n{k}" for k in range(1, 12)) and got[1] == "n1"
    assert (got[20], got[21], got[22]) == ("b > a", "a > b", "a > b > c")
    assert (got[30], got[40]) == ("x", "self")
    assert trees.paths(spark.createDataFrame([], TREE)).count() == 0


def test_a_replaced_tree_leaves_no_orphan(spark):
    rows = [(k, k - 1 if k > 1 else None, f"n{k}", k) for k in range(1, 8)] + [(20, 1, "side", 1), (21, 20, "below it", 2), (30, 31, "a", 0), (31, 30, "b", 0), (None, 3, "null", 3)]
    tree, new = spark.createDataFrame(rows, TREE), spark.createDataFrame([(90, 2, "new", 2)], TREE)
    ids = lambda df: sorted(str(r["id"]) for r in df.collect())
    assert ids(upserts.replaced_tree(tree, new, spark.createDataFrame([(2,)], "id long"))) == sorted("1 2 20 21 30 31 90".split())
    assert ids(upserts.replaced_tree(tree, new, spark.createDataFrame([(30,), (77,)], "id long"))) == sorted([*map(str, range(1, 8)), "20", "21", "30", "90", "None"])
    assert upserts.replaced_tree(tree.limit(0), new, spark.createDataFrame([(2,)], "id long")).count() == 1


def test_workbook_there_and_back(spark, tmp_path):
    rows = spark.createDataFrame([("a<b", 1.5, None), (None, 2.0, "ж & ü"), ("", None, None)], "name string, price double, note string")
    workbook.write_workbook(rows, f"file://{tmp_path}/x.xlsx", order=[F.col("price").asc_nulls_last()])
    found = workbook.read_workbooks(spark, f"file://{tmp_path}")
    got = [(r["row_no"], r["name"], r["price"], r["note"]) for r in workbook.sheet_rows(found, ["name", "price", "note"]).orderBy("row_no").collect()]
    assert got == [(2, "a<b", "1.5", None), (3, None, "2.0", "ж & ü")]


def test_workbooks_as_a_source(spark, tmp_path):
    sheets = {
        "good": [["Name", None, "ean ", "OWN PRICE", "Manufacturer Code", "Supplier SKU", "Image URL", "name"], ["a", "x", "5901234123457", 12.5, "M1", 77.0, "http://i", "second"], [None, " "], ["b", None, None, "abc", "-"], ["c", "x", "1", None, "M2"], ["d", "x", "1", "abc", "M2"]],
        "lacks": [["name", "ean"], ["a", "b"]],
        "empty": [],
    }
    (tmp_path / "w").mkdir()
    for name, rows in sheets.items():
        (tmp_path / "w" / f"{name}.xlsx").write_bytes(workbook.workbook(iter(rows)))
    (tmp_path / "w" / "note.txt").write_text("x")
    found = xlsx_source.read_products(spark, f"file://{tmp_path}/w")
    got = {(r["file"], r["row_no"]): r for r in upserts.product_rows(found).collect()}
    good = got["good.xlsx", 2]
    assert (good["name"], good["sku"], good["supplier_sku"], float(good["own_price"]), good["image_url"], good["error"]) == ("a", "77", "77", 12.5, "http://i", None)
    assert {k: r["error"] for k, r in got.items() if r["error"]} == {
        ("good.xlsx", 3): "Empty row skipped", ("good.xlsx", 4): "ean is required; manufacturer_code is required", ("good.xlsx", 5): "own_price is required", ("good.xlsx", 6): "Invalid own_price: abc",
        ("lacks.xlsx", 1): "Missing required columns: manufacturer_code, own_price", ("empty.xlsx", 1): "Worksheet is empty",
    }


def test_breaker_needs_a_run(spark):
    rows = [(k, 1, f"2024-01-01 00:00:{k:02}", "x" if k not in (3, 7) else None) for k in range(12)]
    got = health.breaker(spark.createDataFrame(rows, "event_id long, listing_id long, captured_at string, error_code string"), ("x",), 3).collect()
    assert [(r["listing_id"], r["event_id"]) for r in got] == [(1, 2)]


def test_export_without_cap(spark):
    rows = spark.range(120)
    assert L.page(rows, [F.asc("id")], None).count() == 120
    assert L.page(rows, [F.asc("id")], 75, 75).count() == 45


def test_variants_are_idempotent(spark):
    have = spark.createDataFrame([(1, "u"), (1, "u"), (2, "u")], "competitor_id long, url string")
    new = spark.createDataFrame([(1, "u"), (1, "v"), (1, "v")], "competitor_id long, url string")
    got = sorted(tuple(r) for r in upserts.with_variants(have, new).collect())
    assert got == [(1, "u", False), (1, "v", True), (2, "u", False)]


CASES = [
    (codes.size_text, "Perfume 1.5 l", "1.5L"),
    (codes.size_text, "12 гр х 3", "12G"),
    (codes.variant_color, "цвят F2 23 мл.", "F2"),
    (codes.gtin_valid, "5901234123457", True),
    (codes.gtin_valid, "11111111", False),
    (lambda x: money.parse_decimal(x).cast("string"), "1,234,567", "1234567.0000"),
    (lambda x: money.parse_decimal(x).cast("string"), "1.299", "1299.0000"),
    (urls.product_url, "https://shop.bg/a.css", None),
    (urls.redirect_target, "https://d.example/l/?uddg=https%3A%2F%2Fa%2Fb", "https://a/b"),
    (fields.error_class, "Timeout 30000ms", "playwright_timeout"),
    (fields.spec_label, "RAM памет", "memory"),
    (lambda x: F.array_join(markup.sitemap_locations(x), " "), '<feed><entry><link href="http://a/1"/></entry></feed>', "http://a/1"),
]


def test_functions_on_single_values_and_null(spark):
    one = spark.range(1)
    for f, value, want in CASES:
        got = one.select(f(F.lit(value)).alias("y"), f(F.lit(None).cast("string")).alias("n")).first()
        assert got["y"] == want, (value, got["y"])


def test_variants_of_pages(spark):
    mark = markup.VARIANT_MARK
    good = '{"url":"/a/p-1/","additionalInfo":"нюанс F2 23 мл.","text":"} \\" {","price":{"value":"12.50","currency":"EUR"},%s}' % mark
    rows = [
        (1, f'<i>{good}, {good} {{"url":"https://o.example/p-2","eanCode":"123",{mark}}}', "https://s.example/x"),
        (2, "no variants {", "https://s.example/x"),
        (3, f"{mark} without a brace, {{{mark}", "https://s.example/x"),
        (4, None, None),
        (5, "", None),
    ]
    got = L.page_variants(spark.createDataFrame(rows, "id long, html string, url string")).orderBy("id", "url").collect()
    assert [(r["id"], r["url"], r["size"], r["color"], r["price"], r["currency"], r["ean"]) for r in got] == [(1, "https://o.example/p-2", None, None, None, None, None)]
    inner = good.replace('"text":"} \\" {",', '"text":"} \\" x",')
    got = L.page_variants(spark.createDataFrame([(1, f"{inner}{inner}", "https://s.example/x")], "id long, html string, url string")).collect()
    assert [(r["url"], r["size"], r["color"], r["price"], r["currency"]) for r in got] == []
    flat = '{%s,"url":"/a/p-1/","additionalInfo":"нюанс F2 23 мл.","text":"} \\" {","price":{"value":"12.50","currency":"EUR"}}' % mark
    got = L.page_variants(spark.createDataFrame([(1, f"x{flat}{flat} tail }}", "https://s.example/x")], "id long, html string, url string")).collect()
    assert [(r["url"], r["size"], r["color"], r["price"], r["currency"]) for r in got] == [("https://s.example/a/p-1/", "23ML", "F2", 12.5, "EUR")]


def test_own_variant(spark):
    kind = "array<struct<sku:string,price:double>>"
    rows = [([("a", 3.0), ("b", None), ("c", 2.0)], "b", 9.0), ([("a", 3.0), ("b", None), ("c", 2.0)], None, 3.0), ([("a", 3.0), ("b", None), ("c", 2.0)], None, None), ([("x", None), ("y", None)], "z", 1.0), ([], "z", 1.0), (None, None, None)]
    got = spark.createDataFrame(rows, f"v {kind}, own string, price double").select(markup.own_variant(F.col("v"), F.col("own"), F.col("price"))["sku"]).collect()
    assert [r[0] for r in got] == ["b", "a", "c", "x", None, None]


def test_swatch_and_prefix_currency(spark):
    area = '<div class="size swatch-attribute"><div class="swatch-attribute-options"><div class="%s">%s</div></div></div>'
    rows = [(area % ("selected", "no amount") + area % ("x active", "30 ml 9,90 € 12 € 8 €"),), (area % ("plain", "30 ml"),), ("<p>x</p>",), (None,)]
    got = [tuple(r[0]) if r[0] is not None else None for r in spark.createDataFrame(rows, "html string").select(markup.swatch(F.col("html"))).collect()]
    assert got[0] == ("30ML", 9.9, 8.0, "EUR")
    assert all(set(g) == {None} for g in got[1:])
    got = spark.createDataFrame([("€ 5,50 или 9.90 лв",)], "x string").select(F.transform(money.price_candidates(F.col("x")), lambda c: F.concat_ws(" ", c["amount"].cast("double"), c["currency"]))).first()[0]
    assert got == ["5.5 EUR", "9.9 BGN"]


def test_first_of_keeps_a_column_named_like_its_rank(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (2, 9, "c")], "k int, _rank int, __RANK string")
    got = ranking.first_of(rows, ["k"], [F.desc("_rank")])
    assert got.columns == ["k", "_rank", "__RANK"] and sorted(map(tuple, got.collect())) == [(1, 5, "a"), (2, 9, "c")]


def test_observations_reduce_before_listings_that_share_them(spark):
    listings = spark.createDataFrame([(1, 7, 1.0), (2, 7, 2.0), (3, 8, 3.0), (4, None, 4.0)], "id long, part long, latest_price double")
    listings = listings.select("*", *(F.lit(None).cast("string").alias(c) for c in ("latest_scrape_status", "latest_scrape_error_code")), F.lit(None).cast("timestamp").alias("latest_scraped_at"))
    seen = spark.createDataFrame([(1, 7, "scraped", None, 5.0), (2, 7, "scraped", None, None), (3, 7, "failed", "x", 9.0), (4, None, "scraped", None, 6.0)], "event_id long, listing_id long, outcome string, error_code string, price double")
    seen = seen.withColumn("captured_at", F.timestamp_seconds("event_id"))
    out = upserts.applied_observations(listings, seen, on="part")
    assert sorted((r["id"], r["latest_price"], r["latest_scrape_status"], r["latest_scrape_error_code"]) for r in out.collect()) == [(1, 5.0, "failed", "x"), (2, 5.0, "failed", "x"), (3, 3.0, None, None), (4, 4.0, None, None)]
