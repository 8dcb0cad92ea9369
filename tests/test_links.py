"""Rules of product, listing and brand URLs, branch by branch, and what a site keeps of its found URLs."""

import pytest
from pyspark.sql import functions as F

from tallymart.functions import product_urls as p

#: URL; strict, external, dynamic, listed; listing, brand.
CASES = [
    (None, "", ""),
    ("", "", "l"),
    ("https://s.bg/", "", "l"),
    ("https://s.bg/bg/p/12", "", ""),  # a hint needs three digits, or a slug of six letters
    ("https://s.bg/bg/p/123", "sed", ""),
    ("https://s.bg/bg/P/123/", "sed", ""),
    ("s.bg/p/123", "sed", ""),  # without a scheme all is path
    ("https://s.bg/product/laptop-15", "d", "l"),
    ("https://s.bg/product/intel", "", "l"),
    ("https://s.bg/intel-b660", "", "l"),
    ("https://s.bg/intel-core-b660", "sed", "l"),
    ("https://s.bg/cats/pazeli-nad-3-godini", "sed", "l"),  # the strict rule comes first
    ("https://s.bg/cats/pazeli-tri", "", "l"),
    ("https://s.bg/x/y/крем-за-лице-50", "sed", ""),
    ("https://s.bg/x/nice-cream-for-faces", "e", "l"),
    ("https://s.bg/x/nice-cream-for-faces?a=1", "", "l"),
    ("https://s.bg/nice-cream-for-faces", "", "l"),  # one segment
    ("https://s.bg/a/b/x/d/nice-cream-for-faces", "", ""),  # five segments
    ("https://s.bg/view?sku=9", "sed", "l"),
    ("https://s.bg/view?sku=", "", "l"),
    ("https://s.bg/view?q=1&Product_ID=7", "sed", "l"),
    ("https://s.bg/blog/intel-core-b660", "", ""),
    ("https://s.bg/p/12345.jpg", "", ""),
    ("https://s.bg/obschi-uslovija-karta-12-2025", "", "l"),
    ("https://s.bg/p/123-brand", "", "l"),
    ("https://s.bg/oferti/intel-core-b660", "s", "l"),
    ("https://s.bg/p/sale-intel-core-b660", "sd", "l"),  # a term among the words bars the external rule only
    ("https://s.bg/sbf-intel-core-b660", "se", "l"),
    ("https://s.bg/a/b/red-box-123", "l", ""),  # a slug of eleven characters
    ("https://s.bg/a/b/red-boxes-123", "sedl", ""),
    ("https://s.bg/a/b/productsegment_x-y-1234", "sed", ""),
    ("https://s.bg/brands/acme", "", "b"),
    ("https://s.bg/a/b/x", "", ""),
    ("https://s.bg/a/shop/c", "", "l"),
    ("https://s.bg/p/1234;v=2", "sed", "l"),
]


def test_each_branch(spark):
    rows = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(CASES)], "k int, u string")
    u = F.col("u")
    marks = lambda **rules: F.concat_ws("", *(F.when(f(u), F.lit(m)) for m, f in rules.items()))
    got = rows.select("k", marks(s=p.is_product, e=p.is_external_product, d=p.is_dynamic_product, l=p.is_listed_product), marks(l=p.is_listing, b=p.is_brand_listing)).collect()
    wrong = [(CASES[k], a, b) for k, a, b in got if (a, b) != CASES[k][1:]]
    assert not wrong


@pytest.mark.parametrize("n_hinted, n_other, kept", [(50, 50, 50), (49, 51, 100), (60, 30, 90), (99, 0, 99)])
def test_a_product_namespace_is_all_if_half_of_a_hundred_share_it(spark, n_hinted, n_other, kept):
    urls = [f"https://www.s.bg/p/{1000 + k}/?utm_source=x" for k in range(n_hinted)] + [f"https://s.bg/intel-core-b{1000 + k}" for k in range(n_other)]
    noise = [("s.bg", None, None), (None, urls[0], None), ("s.bg", "https://shop.s.bg/p/1234", None), ("s.bg", "https://s.bg/x/nice-cream-for-faces", None)]
    rows = spark.createDataFrame([("s.bg", u, None) for u in urls] * 2 + noise, "site string, url string, channel string")
    found = p.found_products(rows).collect()
    assert len(found) == len(set(found)) == kept
    assert all(r.site == "s.bg" and "utm" not in r.url and not r.url.endswith("/") for r in found)


def test_channels_route_to_their_rules(spark):
    rows = spark.createDataFrame([("s.bg", "https://s.bg/x/nice-cream-for-faces", c) for c in ("external", "dynamic", "sitemap", None)] + [("s.bg", "https://s.bg/product/laptop-15", "dynamic")], "site string, url string, channel string")
    assert sorted(r.url for r in p.found_products(rows).collect()) == ["https://s.bg/product/laptop-15", "https://s.bg/x/nice-cream-for-faces"]
    assert p.found_products(rows.limit(0)).count() == 0
