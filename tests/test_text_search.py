"""Search by postings against a scan, and what its plans read."""

import random
import re

import pytest

from tallymart.operators import text_search as T

PATTERNS = ["abc", "AbC", "bca", "a%c", "ab_a", "abcab", "ca", "", "%", "zzz", "ба", "баБ", "a b", "bc%ca", r"\%", "c_b"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcABC абБ%_", k=r.randrange(14)))
    made = [(k * 7 - 300, word() if k % 9 else None, word()) for k in range(700)] + [(5, "abc", None), (5, "xyz", None), (None, "abcab", "abc")]
    return made, spark.createDataFrame(made, "id long, title string, url string")


def test_same_rows_as_a_scan(spark, rows, tmp_path):
    _, table = rows
    index = T.text_index(table, "id", ("title", "url"), f"file://{tmp_path}/i", block=256)
    for text in PATTERNS:
        for columns in (("title",), ("title", "url")):
            want = {x["id"] for x in table.where(T.matches(columns, text)).collect() if x["id"] is not None}
            got = [x["id"] for x in T.search(index, text, columns).collect()]
            assert len(got) == len(set(got)) and set(got) - {None} == want, (text, columns)


def test_grams_of_patterns():
    assert T.pattern_grams("ABCd%ef_ghi") == ["abc", "bcd", "ghi"]
    assert T.pattern_grams("ab%cd") == [] == T.pattern_grams("")


def test_only_blocks_with_candidates_are_read(spark, tmp_path):
    table = spark.range(5000).selectExpr("id", "concat('item ', id, case when id = 777 then ' needle' else '' end) as title")
    index = T.text_index(table, "id", ("title",), f"file://{tmp_path}/i", block=500)
    found = T.search(index, "Needle")
    assert [r["id"] for r in found.collect()] == [777]
    scans = [x for x in found._jdf.queryExecution().toString().splitlines() if "FileScan" in x and "title#" in x]
    assert index.texts.select("block").distinct().count() >= 5
    assert scans and all(re.search(r"\(block#\d+ = \d+\)\]", x.split("PartitionFilters: ")[1]) for x in scans)
    assert T.search(index, "no such thing").count() == 0
    assert T.search(T.text_index(table.limit(0), "id", ("title",), f"file://{tmp_path}/e"), "abc").count() == 0
