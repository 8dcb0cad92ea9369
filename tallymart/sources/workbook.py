"""Spreadsheets: a reader over binary files and a writer of one capped sheet."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
_ROOT = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
_BOOK = '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{}" sheetId="1" r:id="rId1"/></sheets></workbook>'
_LINK = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def workbook(rows: Iterator[list], sheet: str = "products") -> bytes:
    """The bytes of a workbook with one sheet; nulls are left out, numbers are numbers, all else is text."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _ROOT), ("xl/workbook.xml", _BOOK.format(escape(sheet))), ("xl/_rels/workbook.xml.rels", _LINK)):
            z.writestr(name, text)
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for n, row in enumerate(rows, 1):
                cells = "".join(_cell(f"{_letters(k)}{n}", v) for k, v in enumerate(row) if v is not None)
                f.write(f'<row r="{n}">{cells}</row>'.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _cell(at: str, value: object) -> str:
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def cells(raw: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells as text) of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        first = min(n for n in z.namelist() if n.startswith("xl/worksheets/"))
        with z.open(first) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                found: dict[int, str] = {}
                for c in row.iter(f"{_NS}c"):
                    k = 0
                    for letter in c.get("r", "A").rstrip("0123456789"):
                        k = k * 26 + ord(letter) - 64
                    v = c.find(f"{_NS}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                    if text is not None:
                        found[k - 1] = shared[int(text)] if c.get("t") == "s" else text
                yield int(row.get("r", 0)), [found.get(k) for k in range(max(found, default=-1) + 1)]
                row.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, cells) of the first sheet of every workbook below ``path``; files are dealt to tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                found = list(cells(raw.as_buffer().to_pybytes()))
                yield pa.record_batch({"path": pa.array([name] * len(found), pa.string()), "row_no": pa.array([n for n, _ in found], pa.int64()), "cells": pa.array([c for _, c in found], pa.list_(pa.string()))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row_no long, cells array<string>")


def write_workbook(rows: DataFrame, path: str, most: int | None = 50_000, order: list | None = None) -> None:
    """One workbook from the first ``most`` rows (None: all) in ``order``, written by one task to ``path`` through Spark's file systems.

    A sheet holds 1,048,576 rows, so one task can hold what one file can.
    """
    names = rows.columns
    some = rows.orderBy(*order) if order else rows
    some = some if most is None else some.limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[list]:
            yield names
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True) if b.num_rows else ()

        yield pa.record_batch({"content": pa.array([workbook(every())], pa.binary())})

    content = some.coalesce(1).mapInArrow(run, "content binary").first()["content"]
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.sc().hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    out.write(bytearray(content))
    out.close()


def sheet_rows(found: DataFrame, names: list[str]) -> DataFrame:
    """Rows from the second on, with a column for each named header, wherever it stands; blank rows are left out."""
    head = found.where("row_no = 1").select("path", F.transform("cells", lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")).alias("head"))
    body = found.where("row_no > 1").join(head, "path")
    at = lambda n: F.get(F.col("cells"), (F.array_position("head", n) - 1).cast("int"))
    columns = [F.when(F.array_contains("head", n), at(n)).alias(n) for n in names]
    return body.where(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")).select("path", "row_no", *columns)
