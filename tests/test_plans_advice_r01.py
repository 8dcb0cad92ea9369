"""Whole jobs that the first round of advice found cut."""

from tallymart.operators import matching as M
from tallymart.plans import matching, relational
from tallymart.sources.adapters import Domain

PRODUCTS = [(1, "n", "Acme", "111", "MC1", "S1", "M1"), (2, "n", "ACME", None, None, "S2", "M2"), (3, "n", "Other", None, None, "S3", None), (4, "n", None, None, None, None, None)]
OFFERS = [
    (10, "by ean", None, "111", None, None, None, None),
    (11, "by code", None, None, "MC1", None, None, None),
    (12, "by brand and model", "acme", None, None, "m2", None, None),
    (13, "by brand", " acme", None, None, " ", None, None),
    (14, "by sku", None, None, None, None, "S3", None),
    (15, "by nothing", None, " ", None, "m2", None, None),
    (16, "in vain", "none", "999", None, None, None, None),
]


def _domain(spark, **tables):
    d = Domain(spark, "")
    d._made.update(tables)
    return d


def _catalog(spark):
    products = spark.createDataFrame(PRODUCTS, "id long, name string, brand string, ean string, manufacturer_code string, sku string, model string")
    offers = spark.createDataFrame(OFFERS, "id long, title string, brand string, ean string, manufacturer_code string, model string, sku string, spec_storage string")
    return _domain(spark, products=products, offers=offers)


def test_prefilter_uses_all_its_keys(spark):
    want = {("by ean", 1), ("by code", 1), ("by brand and model", 2), ("by brand", 1), ("by brand", 2), ("by sku", 3)} | {("by nothing", k) for k in (1, 2, 3, 4)}
    assert sorted(tuple(r) for r in matching.jn_prefilter_candidates(_catalog(spark)).collect()) == sorted(want)


def test_blocking_counts_the_pairs_of_all_its_keys(spark):
    d = _catalog(spark)
    n = matching.jn_block_candidates(d).first()["n"]
    assert n == M.candidates(M.identities(d.offers), d.products).count() > 1


def test_snapshot_of_odd_and_even_listings(spark):
    listings = spark.createDataFrame([(1, None, None), (2, None, None), (3, 5.0, None), (4, None, None), (5, None, None)], "id long, latest_price double, latest_promo_price double")
    snapshots = spark.createDataFrame([(k, "1998-01-01", 1, 1, 1.0) for k in (1, 2, 3)], "listing_id long, captured_at string, order_id long, line_no int, tie double")
    got = relational.prj_snapshot_dto(_domain(spark, listings=listings, price_snapshots=snapshots))
    assert {r["id"]: r["source"] for r in got.collect()} == {1: "snapshot", 2: "snapshot", 3: "listing", 4: "none", 5: "none"}
