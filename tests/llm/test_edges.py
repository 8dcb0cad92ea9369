"""Operators over pages and benchmark items, written shards and each pipeline stage: odd rows, repeats, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallymart.llm import decontaminate, html_extract, sharding, warc_zip

CLASH = "host low nodes node payload sha first own_bytes record_type refers_to url2 page page2 package of target text2 row_id hash at hits shift shifts tokens bits own prefix s row n_bytes depth bad_id bad_text score predicted held_out rep component".split()


def clashing(df):
    """``df`` with a text column of each name that an operator might use itself."""
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH if c not in df.columns))


PAGES = [
    (1, "http://h/a", "<article><p>One</p></article>"),
    (1, "http://h/a", "<article><p>One</p></article>"),
    (2, None, None),
    (None, "http://h/b", "<p>Null id</p>"),
    (3, "http://h/c", ""),
    (4, "no url at all", "<p>" + "long " * 50_000 + "</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return clashing(spark.createDataFrame(PAGES, "page_id long, url string, html string"))


def test_extraction_of_odd_pages(pages):
    want = [(1, "One"), (1, "One"), (2, ""), (None, "Null id"), (3, ""), (4, ("long " * 50_000).strip())]
    got = html_extract.extracted(pages).collect()
    assert sorted([(r["page_id"], r["text"]) for r in got], key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 3, 300])
def test_text_before_an_article_stays_however_long_the_article(n):
    body = " ".join(["Many words of text."] * n)
    assert html_extract.main_text(f"<h1>Title here</h1><p>Lead</p><article><p>{body}</p></article>", {}) == f"Title here Lead {body}"
    assert html_extract.main_text(f"<nav>Menu</nav><h1>Title</h1><main><p>{body}</p></main><footer>Foot</footer>", {}) == f"Title {body}"


def test_site_style_decides_what_lies_around_an_article(spark):
    page = "<div class='k1'>All pages say this</div><h1>Title {0}</h1><article><p>Story {0} with its own words {0}.</p></article><div class='k2'>Write to us</div>"
    rows = [(k, f"http://site/{k}", page.format(k)) for k in range(20)]
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k} Story {k} with its own words {k}." for k in range(20)}


def test_archives_of_odd_pages(pages):
    got = sorted([(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_zip.archived(pages).collect()], key=str)
    sizes = [len((h or "").encode()) for _, _, h in PAGES]
    want = [(1, sizes[0], "response", None)] * 2 + [(2, 0, "response", None), (3, 0, "revisit", 2), (None, sizes[3], "response", None), (4, sizes[5], "response", None)]
    assert got == sorted(want, key=str)
    assert warc_zip.archived(pages.limit(0)).count() == 0


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
DOCS = [
    (1, f"before {ITEM} after"),
    (1, f"before {ITEM} after"),
    (2, None),
    (3, ""),
    (None, ITEM.replace("zeta", "other")),
    (4, "clean words only"),
    (5, "filler " * 40_000 + ITEM),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(DOCS, "doc_id long, text string")
    return clashing(rows.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long")))


@pytest.fixture(scope="module")
def items(spark):
    return clashing(spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, ""), (None, "clean words only")], "item_id long, text string"))


def test_overlaps_of_odd_rows(docs, items):
    got = {(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(1, 7, 1), (None, 7, 0), (5, 7, 40_000)}
    assert sorted(str(r["doc_id"]) for r in decontaminate.decontaminated(docs, items).collect()) == ["2", "3", "4"]
    assert decontaminate.overlaps(docs.limit(0), items).count() == decontaminate.overlaps(docs, items.limit(0)).count() == 0
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == len(DOCS)


def test_shards_of_odd_rows(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    shards = sharding.write_shards(docs, folder, 200)
    rows = spark.read.parquet(folder)
    assert sorted(str((r["doc_id"], r["text"])) for r in rows.collect()) == sorted(str(r) for r in DOCS)
    assert set(docs.columns) < set(rows.columns) and shards.agg(F.sum("shard_rows")).first()[0] == len(DOCS)
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("shard", F.lit(1)), folder)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_rows(name, spark, sf_dir, docs):
    stage = dict(corpus_pipeline.STAGES)[name]
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    given = known.unionByName(docs, allowMissingColumns=True)
    out = stage(spark, given, sf_dir)
    got = out.collect()
    ids = sorted(str(r["doc_id"]) for r in given.select("doc_id").collect())
    if name == "tokens":
        assert sorted(str(r["doc_id"]) for r in got) == ids
    else:
        assert out.columns == list(corpus_pipeline.COLUMNS)
        assert all(str(r["doc_id"]) in ids for r in got) and len(got) <= len(ids)
    assert stage(spark, given.limit(0), sf_dir).count() == 0
