"""A table by key in the shared folder, whose merges rewrite only the buckets that they touch.

Rows lie in a fixed number of buckets by a hash of their key. A merge reads the
buckets of its changes, writes their new state into folders of its own, and then
commits by creating the next manifest, a small file that names the folder of
each bucket. Until that file exists the old state stands, so a run that fails
changes nothing; of two runs that start from one version the second is refused.
A batch with a number is applied once, however often it comes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymart.sources.scratch import tidy

BUCKETS = 64
_BUCKET = "bucket_"

Combine = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """``schema`` (DDL) and ``key`` tell rows; the first of them made at ``path`` sets the number of buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema)
        self.buckets = int(self.manifest().get("count", buckets))

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()), path

    def version(self) -> int:
        """The latest committed version, 0 for a new table."""
        fs, path = self._file("manifests")
        if not fs.exists(path):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What a version says: the folder of each bucket, and the last batch applied of each source."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:09}", wholetext=True).first()[0])

    def _folders(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the latest by default."""
        return self._folders(sorted(self.manifest(version).get("folders", {}).values()))

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows in the buckets of ``keys``, a superset of those with these keys."""
        folders = self.manifest().get("folders", {})
        return self._folders(sorted(folders[b] for b in self._touched(keys) if b in folders))

    def _touched(self, rows: DataFrame) -> list[str]:
        # at most as many numbers as there are buckets
        return sorted(str(r[0]) for r in rows.select(self.bucket().alias(_BUCKET)).distinct().collect())

    def merge(self, changes: DataFrame, combine: Combine, source: str = "", batch: int | None = None, marks: dict[str, int] | None = None) -> bool:
        """Replace the touched buckets by ``combine(old rows of them, changes)``; False if ``batch`` of ``source`` was applied before.

        ``combine`` keeps keys in their bucket and returns the table's columns,
        each key once. Changes with a null in the key are rows like others.
        ``marks`` are numbers that the manifest keeps, a watermark for example.
        """
        start = self.version()
        now = self.manifest(start)
        done = now.get("done", {})
        if batch is not None and done.get(source, -1) >= batch:
            return False
        touched = self._touched(changes)
        folders = dict(now.get("folders", {}))
        if touched:
            run = f"data/{uuid.uuid4().hex[:12]}"
            old = self._folders(sorted(folders[b] for b in touched if b in folders))
            new = combine(old, changes).select(*self.schema.names).withColumn(_BUCKET, self.bucket())
            with tidy(self.spark):
                new.repartition(_BUCKET).write.partitionBy(_BUCKET).option("compression", "zstd").parquet(f"{self.path}/{run}")
            fs, made = self._file(run)
            have = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(made)}
            for b in touched:
                folders.pop(b, None)
                if b in have:
                    folders[b] = f"{run}/{_BUCKET}={b}"
        if batch is not None:
            done = {**done, source: batch}
        self._commit(start + 1, {"count": self.buckets, "folders": folders, "done": done, "marks": now.get("marks", {}) | (marks or {})})
        return True

    def forget(self) -> None:
        """Delete the data that the version before the latest names and the latest doesn't; the older version can't be read any more."""
        start = self.version()
        if start > 1:
            now = set(self.manifest(start)["folders"].values())
            for f in set(self.manifest(start - 1)["folders"].values()) - now:
                fs, path = self._file(f)
                fs.delete(path, True)

    def _commit(self, version: int, said: dict) -> None:
        """Create the manifest of a version; an error if another run has made it."""
        fs, path = self._file(f"manifests/{version:09}")
        _, draft = self._file(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        fs.mkdirs(path.getParent())
        if fs.exists(path) or not fs.rename(draft, path):
            raise RuntimeError(f"version {version} was committed by another run")


def newer_wins(key: tuple[str, ...], schema: StructType) -> Combine:
    """A change replaces the row of its key; null fields of the change leave the old value."""

    def combine(old: DataFrame, changes: DataFrame) -> DataFrame:
        rest = [c for c in schema.names if c not in key]
        both = old.alias("o").join(changes.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
        return both.select(*(F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in key), *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in rest))

    return combine
