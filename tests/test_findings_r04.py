from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallymart.operators import latest
from tallymart.operators import matching as M
from tallymart.plans import matching, relational
from tallymart.sources.adapters import Domain
from tallymart.streaming import discovery

FIELDS = "name string, brand string, ean string, manufacturer_code string, sku string, model string, storage string, color string, memory string"
OFFER = "id long, title string, brand string, ean string, manufacturer_code string, model string, sku string, spec_storage string, spec_color string, spec_memory string"


def _shop(spark):
    """A catalog whose best product for the offer comes after more products with as many of its words, and of its brand, than the reference's blocks take."""
    rows = [(k, f"steel kettle number {k:04}", "Acme", *[None] * 7) for k in range(M.BRAND_CANDIDATES + 100)]
    best = (5000, "steel kettle of 2 l", "Acme", *[None] * 7)
    products = spark.createDataFrame([*rows, best], f"id long, {FIELDS}")
    offers = spark.createDataFrame([(1, "Steel kettle of 2 L", "acme", *[None] * 7), (2, "steel kettle of 2 l", "other", *[None] * 7)], OFFER)
    return SimpleNamespace(products=products, offers=offers)


def test_matching_meets_products_beyond_the_reference_blocks(spark):
    d = _shop(spark)
    top = {(r["offer_id"], r["rank"]): r["id"] for r in matching.win_topk_candidates(d).collect()}
    assert top[1, 1] == 5000, top
    assert {r["id"]: r["product_id"] for r in matching.q_match_batch(d).collect()}[1] == 5000
    decided = {r["id"] for r in matching.match_rules(d).where("offer_id = 2").collect()}
    assert decided == {r["id"] for r in d.products.collect()}  # the brands conflict


def test_products_that_identifiers_tell_apart_take_no_place_away(spark):
    """An offer's own products by EAN have the texts of others; as many of these are looked at as are told apart."""
    eans = {k: "5901234123457" if k % 2 else None for k in range(12)}
    products = spark.createDataFrame([(k, "steel kettle", "Acme", eans[k], None, "SKU-77001" if k == 4 else None, None, "64 gb" if k == 6 else None, None, None) for k in eans], f"id long, {FIELDS}")
    offers = spark.createDataFrame([(1, "steel kettle sku 77001", "acme", "5901234123457", None, None, None, "64", None, None), (2, "steel kettle", None, None, None, None, None, None, None, None)], OFFER)
    o = M.identities(offers)
    pairs = M.scored(M.whole_pairs(M.prepared_offers(o), M.prepared_products(products)))
    for top in (1, 6, 9, 12):
        want = {}
        for r in pairs.where("score >= 1").collect():
            want.setdefault(r["offer_id"], []).append((-r["score"], r["id"]))
        got = {}
        for r in M.ranked(o, products, top).orderBy("rank").collect():
            got.setdefault(r["offer_id"], []).append((-r["score"], r["id"]))
        assert got == {k: sorted(v)[:top] for k, v in want.items()}


def test_pairs_of_blocks_are_not_shuffled_to_be_told_apart(spark):
    d = _shop(spark)
    o = M.identities(d.offers)
    plan = M.candidates(o, d.products)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
    found = [tuple(r) for r in M.candidates(o, d.products).collect()]
    assert len(found) == len(set(found)) and sum(o == 1 for o, _ in found) == M.BRAND_CANDIDATES


def test_prefilter_looks_equal_titles_up_once(spark):
    d = _shop(spark)
    offers = d.offers.limit(1).select("title", "brand", "ean", "manufacturer_code", "model", "sku").withColumn("offer_id", F.explode(F.sequence(F.lit(1), F.lit(500))))
    pairs = M.prefiltered(offers, d.products, "title")
    assert pairs.columns == ["title", "id"] and pairs.count() == M.PREFILTER_LIMIT


@pytest.mark.parametrize("name", ["flt_search_export", "flt_search_workspace"])
def test_one_search_writes_no_index(spark, sf_dir, same, name):
    d = Domain(spark, sf_dir)
    same(getattr(relational, name)(d), entry.oracle_sql()[name])
    assert not d._indexes


def _folders(path):
    return [f for f in path.rglob("bucket_=*") if f.is_dir()]


def test_a_stream_of_discoveries_leaves_one_version_of_the_store(spark, tmp_path):
    table = discovery.store(spark, f"file://{tmp_path}/store", 4)
    for k in range(3):
        rows = [(0, f"https://a.example/{k}/{i}", None, "c") for i in range(40)]
        spark.createDataFrame(rows, "site long, url string, code string, category string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    found = spark.readStream.schema("site long, url string, code string, category string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    discovery.discovery_stream(found, table, f"file://{tmp_path}/offsets").awaitTermination()
    assert table.version() == 3 and discovery.listings(table).count() == 120
    assert len(_folders(tmp_path / "store")) == 4


def test_new_snapshots_are_ranked_once(spark, tmp_path):
    rows = [(i % 5, datetime(2024, 1, 1 + i), i, 1, float(i)) for i in range(20)]
    snapshots = spark.createDataFrame(rows, "listing_id long, captured_at timestamp, order_id long, line_no int, tie double")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    table = latest.latest_table(snapshots, f"file://{tmp_path}/latest", 4)
    assert latest.advance(table, snapshots.mapInArrow(count, snapshots.schema))
    assert seen.value == 20 and {r["order_id"] for r in table.read().collect()} == {15, 16, 17, 18, 19}
