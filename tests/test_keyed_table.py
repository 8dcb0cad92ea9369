"""Merges by bucket and the discovery stream: replays, failures, repeats, late items."""

import random

import pytest
from pyspark.sql import functions as F

from tallymart.sources.keyed_table import KeyedTable, newer_wins
from tallymart.streaming import discovery as D

SCHEMA = "sku string, name string, price double"
ITEMS = "site long, url string, code string, category string"


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("sku",), 8)
    assert t.read().count() == 0 and t.version() == 0
    win = newer_wins(("sku",), t.schema)
    t.merge(spark.createDataFrame([(f"s{k}", f"n{k}", float(k)) for k in range(40)], SCHEMA), win)
    before = t.manifest()["folders"]
    t.merge(spark.createDataFrame([("s3", None, 99.0), ("new", "x", None), (None, "no sku", 1.0)], SCHEMA), win)
    after = t.manifest()["folders"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 3 and set(before) - changed == {b for b in after if after[b] == before.get(b)}
    got = {r["sku"]: (r["name"], r["price"]) for r in t.read().collect()}
    assert got["s3"] == ("n3", 99.0) and got["new"] == ("x", None) and got[None] == ("no sku", 1.0) and len(got) == 42
    assert {r["sku"] for r in t.read(1).collect()} == {f"s{k}" for k in range(40)}
    assert KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("sku",), 99).buckets == 8


def test_failed_and_concurrent_runs_leave_the_old_state(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("sku",), 4)
    win = newer_wins(("sku",), t.schema)
    t.merge(spark.createDataFrame([("a", "x", 1.0)], SCHEMA), win)
    change = spark.createDataFrame([("a", "y", 2.0)], SCHEMA)
    with pytest.raises(Exception, match="broken"):
        t.merge(change, lambda old, new: win(old, new).withColumn("name", F.raise_error(F.lit("broken")).cast("string")))
    assert rows_of(t) == [("a", "x", 1.0)]

    def meanwhile(old, new):
        t2 = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ("sku",), 4)
        t2.merge(spark.createDataFrame([("b", "z", 3.0)], SCHEMA), win)
        return win(old, new)

    with pytest.raises(RuntimeError, match="another run"):
        t.merge(change, meanwhile)
    assert rows_of(t) == [("a", "x", 1.0), ("b", "z", 3.0)]


def test_batches_are_applied_once(spark, tmp_path):
    t = D.store(spark, f"file://{tmp_path}/d", 4)
    first = spark.createDataFrame([(1, "u1", "c1", None), (1, "u1", None, "x"), (1, "u2", "c1", None), (1, None, "c9", None), (None, "u1", None, None)], ITEMS)
    assert D.discover(t, first, 0) and not D.discover(t, first, 0)
    assert D.discover(t, spark.createDataFrame([(1, "u9", "c1", "cat"), (1, "u3", None, None), (2, "u1", "c1", None)], ITEMS), 1)
    got = sorted(((r["site"], r["url"], r["code"], r["category"], r["batch"]) for r in D.listings(t).collect()), key=str)
    assert got == sorted([(1, "u1", "c1", "cat", 0), (None, "u1", None, None, 0), (1, "u3", None, None, 1), (2, "u1", "c1", None, 1)], key=str)
    assert not D.discover(t, first, 1)


def test_stream_equals_the_batch(spark, tmp_path):
    r = random.Random(2)
    items = [(r.randrange(2), f"u{r.randrange(60)}", None, None) for _ in range(200)]
    for k in range(4):
        spark.createDataFrame(items[k * 50 : k * 50 + 50], ITEMS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    t = D.store(spark, f"file://{tmp_path}/d", 8)
    for _ in range(2):
        stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        D.discovery_stream(stream, t, f"file://{tmp_path}/c").awaitTermination()
        got = [(x["site"], x["url"]) for x in D.listings(t).collect()]
        assert sorted(got) == sorted({x[:2] for x in items}) and t.manifest()["done"]["discovery"] >= 3
    # late and repeated items in a further file
    spark.createDataFrame([(0, items[0][1], None, None), (1, "late", None, None)], ITEMS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    D.discovery_stream(spark.readStream.schema(ITEMS).parquet(f"file://{tmp_path}/in"), t, f"file://{tmp_path}/c").awaitTermination()
    assert sorted((x["site"], x["url"]) for x in D.listings(t).collect()) == sorted({x[:2] for x in items} | {(0, items[0][1]), (1, "late")})
