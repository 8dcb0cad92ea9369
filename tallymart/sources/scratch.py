"""Tables that a step writes and the next ones read: the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or a temporary one where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallymart-domain-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tallymart-domain/{uuid.uuid4().hex[:12]}"


#: Spark's setting that deletes the shuffle files of a statement once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; they would stay until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back; the shuffle files that it took are deleted."""
    path = f"{scratch(df.sparkSession)}/{name}"
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what :func:`kept` has written, once nothing reads it any more."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)
