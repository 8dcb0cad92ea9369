"""Whole jobs that a third round found cut."""

import __spark_entry__ as entry


def test_src_html_reads_prices_of_all_pages(spark, sf_dir, same):
    got = entry.queries()["src_html"](spark, sf_dir)
    same(got, entry.oracle_sql()["src_html"])
    rows = got.collect()
    count = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    assert len(rows) == count("part") + count("pages")
    assert {r["source"] for r in rows} == {"json_ld", "gtag_view_item", ".product-price", None}
    assert {r["currency"] for r in rows if r["price"] is not None} == {"BGN", "EUR"}
