"""Disk that a third round found taken: shuffle files kept after use, texts shuffled again and again."""

import os
import re
import time

from tallymart.llm import ngram_join
from tallymart.llm.common import stored


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_")}


def test_shuffle_files_end_with_the_table_that_took_them(spark):
    before = shuffle_files(spark)
    table = stored(spark.range(20_000).selectExpr("id % 997 AS k", "id").repartition(3, "k").groupBy("id").count(), "files")
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert table.count() == 20_000


def test_representatives_shuffle_texts_once_and_keep_no_prefixes(spark, monkeypatch):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, text(1), "a"), (2, text(1), "b"), (2, text(1), "b"), (3, text(3), "c"), (3, text(4), "d"), (4, text(5) + " end", "e"), (9, text(5), "f"), (None, text(7), "g"), (None, text(7), "h"), (5, None, "i"), (6, "", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rank string")
    tables = {}

    def noted(df, name):
        tables[name] = stored(df, name)
        return tables[name]

    monkeypatch.setattr(ngram_join, "stored", noted)
    got = ngram_join.representatives(docs)
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    kept = {name for name, t in tables.items() if any(os.path.exists(f.removeprefix("file://")) for f in t.inputFiles())}
    # with texts of 26 shingles, one word more still links at 0.8
    assert [k for k, _ in found] == [0, 0, 1, 3, 4, 5, 6]
    moved = [x for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (\[.*\])", plan) if re.search(r"\btext#", x)]
    assert len(moved) == 1
    assert got.columns == docs.columns
    assert "kept-ids" in kept and not kept & {"shingle-sets", "shingle-leads"}
