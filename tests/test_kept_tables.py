"""The latest table after increments, sitemaps with cycles, pages of a feed with a hot price."""

import random

from tallymart.functions import markup
from tallymart.operators import frontier, latest, price_pages
from tallymart.operators.ranking import latest_price

SNAPSHOT = "listing_id long, price double, captured_at timestamp, order_id long, line_no int, tie double"


def test_latest_table_equals_the_window_after_each_increment(spark, tmp_path):
    from datetime import datetime, timedelta

    r = random.Random(1)
    rows = [(r.randrange(30) or None, float(k), datetime(2024, 1, 1) + timedelta(hours=r.randrange(40) + 10 * (k // 60)), r.randrange(3), r.randrange(2), float(k)) for k in range(240)]
    table = latest.latest_table(spark.createDataFrame(rows, SNAPSHOT), f"file://{tmp_path}/l", 4)
    same = lambda df: sorted((str(x["listing_id"]), x["tie"]) for x in df.collect())
    versions = []
    for n in (60, 120, 180, 240):
        some = spark.createDataFrame(rows[:n], SNAPSHOT)
        assert latest.advance(table, some, lateness=40 * 3600)
        assert same(table.read()) == same(latest_price(some))
        versions.append(table.version())
        assert not latest.advance(table, some, lateness=40 * 3600) and table.version() == versions[-1]
    stored = f"file://{tmp_path}/s"
    some.write.parquet(stored)
    plan = latest.increment(table, spark.read.parquet(stored))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(GreaterThanOrEqual(captured_at" in plan
    assert not latest.advance(table, some.limit(0))


def test_sitemaps_to_a_fixed_point(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    files = [("http://a/0", index("http://a/1", "http://a/2")), ("http://a/1", index("http://a/0", "http://a/3", "http://a/missing")), ("http://a/2", "<urlset><url><loc><![CDATA[http://a/p?x=1&amp;y]]></loc></url><url><loc>http://a/sitemap3.xml</loc></url></urlset>"),
             ("http://a/3", "http://a/q\r\nftp://no\nhttp://a/sitemap_4.xml.gz"), ("http://a/sitemap3.xml", "<broken <loc>"), (None, index("http://a/never")), ("http://b", index("http://b/1")), ("http://a/sitemap_4.xml.gz", "<feed><entry><link href='http://a/e'/></entry></feed>"), ("http://a/2", None)]
    bodies = spark.createDataFrame(files, "url string, body string")
    got = {tuple(x) for x in frontier.followed(bodies, spark.createDataFrame([("http://a/0",), (None,)], "url string")).collect()}
    maps = {"http://a/0", "http://a/1", "http://a/2", "http://a/3", "http://a/missing", "http://a/sitemap3.xml", "http://a/sitemap_4.xml.gz"}
    assert got == {(u, "sitemap") for u in maps} | {(u, "page") for u in ("http://a/p?x=1&y", "http://a/q", "http://a/e")}
    assert frontier.followed(bodies, bodies.limit(0)).count() == 0
    assert bodies.limit(0).select(markup.sitemap_parts(bodies["body"])).count() == 0


def test_every_item_is_in_one_page_hot_price_included(spark):
    r = random.Random(5)
    rows = [(k, r.choice([9.99, 9.99, 9.99, r.random() * 1000, None, -3.0, 1e15])) for k in range(600)]
    items = spark.createDataFrame(rows, "id long, price double")
    got = price_pages.price_pages(items, "price", "id", 20).collect()
    assert sorted(x["id"] for x in got) == list(range(600))
    sizes = {}
    for x in got:
        sizes.setdefault(x["page"], []).append(x)
    assert all(len(v) == v[0]["page_items"] <= 20 for v in sizes.values())
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    assert price_pages.price_pages(items.limit(0), "price", "id").count() == 0
    assert {x["page"] for x in price_pages.price_pages(items.limit(5), "price", "id").collect()} == {""}
    many = price_pages.price_pages(spark.createDataFrame([(1, 5.0)] * 30 + [(2, 5.0)], "id long, price double"), "price", "id", 10).collect()
    assert len(many) == 31 and max(x["page_items"] for x in many) == 30
