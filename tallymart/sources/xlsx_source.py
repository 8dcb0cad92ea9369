"""Workbooks of products as a Spark data source, a file to a partition, and as files that tasks write.

``spark.dataSource.register(Workbooks)`` makes ``spark.read.format("workbooks")``
known. Headers are mapped to columns in the reader, so a task gives rows of the
columns asked for and nothing else of a sheet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tallymart.sources.workbook import cells, workbook

# Headers that a sheet must have, and those that it may have.
REQUIRED = ("ean", "manufacturer_code", "name", "own_price")
OPTIONAL = ("sku", "supplier_sku", "brand", "category", "model", "product_url", "image_url", "description", "variant", "color", "size", "storage", "memory")
SCHEMA = "file string, row_no int, error string, " + ", ".join(f"{c} string" for c in (*REQUIRED, *OPTIONAL))
BATCH = 1000


def _header(cell: str | None) -> str:
    return re.sub(r"\s+", "_", (cell or "").strip().lower())


class SheetFile(InputPartition):
    """One workbook."""


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str) -> None:
        self.names, self.types, self.path = [f.name for f in schema.fields], [f.dataType.simpleString() for f in schema.fields], path

    def partitions(self) -> list[SheetFile]:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(at)
        found = fs.get_file_info(pyarrow.fs.FileSelector(at)) if info.type == pyarrow.fs.FileType.Directory else [info]
        return [SheetFile(x) for x in sorted(f.path for f in found) if x.endswith(".xlsx")]

    def read(self, partition: SheetFile) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.value) as f:
            raw = f.read()
        rows: list[tuple] = []
        for row in self._rows(partition.value.rpartition("/")[2], raw):
            rows.append(row)
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"int": pa.int32(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), self.types, strict=True)], self.names)

    def _rows(self, file: str, raw: bytes) -> Iterator[tuple]:
        def told(at: int, error: str | None, values: dict[str, str | None]) -> tuple:
            own = {"file": file, "row_no": at, "error": error}
            return tuple(own[n] if n in own else values.get(n) for n in self.names)

        place, last = None, 1
        for at, row in cells(raw):
            if place is None:
                place = {h: k for k, h in reversed(list(enumerate(map(_header, row)))) if h}
                missing = sorted(set(REQUIRED) - set(place))
                if missing:
                    yield told(1, f"Missing required columns: {', '.join(missing)}", {})
                    return
                continue
            # rows that a sheet leaves out are empty ones
            for gap in range(last + 1, at):
                yield told(gap, "Empty row skipped", {})
            last = at
            blank = not any((x or "").strip() for x in row)
            values = {n: row[place[n]] for n in self.names if n in place and place[n] < len(row)}
            yield told(at, "Empty row skipped" if blank else None, {} if blank else values)
        if place is None:
            yield told(1, "Worksheet is empty", {})


class Workbooks(DataSource):
    """Rows of all workbooks in a folder or of one: file, row_no, error and the columns asked for, as text.

    ``error`` tells of empty sheets, missing headers (row 1) and empty rows;
    other rows are given as they are. Headers count in any case, with blanks for
    underscores; of two equal ones the first does, unknown ones are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options["path"])


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all workbooks below ``path``."""
    spark.dataSource.register(Workbooks)
    return spark.read.format("workbooks").load(path)


def write_products(rows: DataFrame, by: str, order: str, headers: dict[str, str], folder: str) -> DataFrame:
    """A workbook for each value of ``by``, written by the task that holds its rows, in ``order``: (file, rows).

    ``headers`` names the columns of the sheet. A file holds at most the
    1,048,576 rows that a sheet can.
    """

    def run(group: pa.Table) -> pa.Table:
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        own = group.sort_by(order)
        name = f"{own.column(by)[0].as_py()}.xlsx"

        def every() -> Iterator[list]:
            yield list(headers.values())
            yield from map(list, zip(*(own.column(c).to_pylist() for c in headers), strict=True))

        with fs.open_output_stream(f"{at}/{name}") as out:
            out.write(workbook(every()))
        return pa.table({"file": [name], "rows": [group.num_rows]})

    return rows.groupBy(by).applyInArrow(run, "file string, rows long")
