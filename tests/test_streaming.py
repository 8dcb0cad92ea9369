from tallymart.operators.health import fold
from tallymart.sources.adapters import Domain
from tallymart.streaming.health import health_stream


def test_stream_ends_as_the_batch_fold(spark, sf_dir, tmp_path):
    rows = Domain(spark, sf_dir).outcomes.orderBy("captured_at", "event_id")
    ids = [r[0] for r in rows.select("event_id").collect()]
    parts = [rows.where(rows.event_id.isin(ids[k::1][:500] if k == 0 else ids[500:])) for k in (0, 1)]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = health_stream(stream).writeStream.outputMode("update").format("memory").queryName("health_states").start()
    q.processAllAvailable()
    q.stop()
    seen = {}
    for r in spark.sql("SELECT * FROM health_states").collect():
        seen.setdefault(r["listing_id"], []).append((r["timeouts"], r["not_found"], r["is_dead"]))
    want = {r["listing_id"]: (r["timeouts"], r["not_found"], r["is_dead"]) for r in fold(Domain(spark, sf_dir).outcomes).collect()}
    assert set(seen) == set(want)
    assert all(want[k] in v for k, v in seen.items())


def test_dead_stays_dead(spark):
    rows = [(k, 1, f"2024-01-01 00:00:0{k}", o, c) for k, (o, c) in enumerate([("failed", "product_not_found"), ("failed", "product_not_found"), ("scraped", None)])]
    r = fold(spark.createDataFrame(rows, "event_id long, listing_id long, captured_at string, outcome string, error_code string")).first()
    assert (r["timeouts"], r["not_found"], r["is_dead"]) == (0, 0, True)
