import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cells(rows):
    """Rows in a form that compares across engines."""
    one = lambda x: "~" if str(x) in ("None", "nan", "<NA>", "NaT") else round(float(x), 5) if isinstance(x, float) else str(x)
    return sorted([tuple(one(x) for x in r) for r in rows], key=str)


@pytest.fixture(scope="session")
def same(duck):
    """Compare a DataFrame with SQL, column by column name, in any order of rows."""

    def check(df, sql):
        columns = sorted(df.columns)
        got = df.select(*[f"`{c}`" for c in columns]).collect()
        found = duck.execute(sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        want = [[r[names.index(c)] for c in columns] for r in found.fetchall()]
        assert cells(got) == cells(want)

    return check
