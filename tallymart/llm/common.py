"""Table access, scratch tables and small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of whole texts that go to a Python worker at once, where the session leaves it at Spark's 10,000.
ARROW_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Delete shuffle files when a query ends; otherwise they stay until the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[..., Batches]) -> Callable[..., Batches]:
    """``run`` for a Python worker that lives on: what it has freed goes back to the system when its task ends."""

    def freed() -> None:
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            freed()

    def group_task(key: tuple[pa.Scalar, ...], batches: Batches) -> Batches:
        try:
            yield from run(key, batches)
        finally:
            freed()

    # Spark tells the two apart by their arguments
    chosen = task if len(inspect.signature(run).parameters) == 1 else group_task
    chosen.__annotations__ = dict.fromkeys(("batches", "return"), Iterator[pa.RecordBatch]) | ({} if chosen is task else {"key": tuple[pa.Scalar, ...]})
    return chosen


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of each row, and the columns named in ``more``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Where the session names none (tests on one machine), it is set to a
    temporary folder; a cluster must name a shared one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get() if context.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallymart-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` in the shared folder."""
    return f"{scratch_dir(spark)}/tallymart/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage is cut there, and the shuffle files that it took are deleted."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The file of a public vocabulary: in ``folder``, or where the ``public_tokenizers`` package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
