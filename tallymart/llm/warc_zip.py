"""WARC archives packaged in ZIP files, written and read by ranges.

A package holds ``archive/data.warc.gz`` (a gzip member for each record) and
``indexes/index.cdxj`` (a line for each record with its offset and length), both
stored. The reader parses the package's directory, reads the index, and then
only the ranges of the records, neighbours together.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

from tallymart.llm import zip_members as Z
from tallymart.llm.common import scratch_path, stored

#: A package is closed after so many bytes of records; a range read covers so many at most, or one record.
PACKAGE_BYTES, RANGE_BYTES = 24 << 20, 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI that Hadoop uses, and the path there."""
    # Hadoop's names of a scheme that Arrow knows by another
    path = re.sub("^s3[an]://", "s3://", path)
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, of: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or (``payload`` None) a revisit of page ``refers_to``."""
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {of}')}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = [f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{of}")
    if payload is None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = http + (payload or b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write the ZIP packages; returned is the list of them: package, n_records.

    Of pages with equal payloads that with the least page_id becomes a response,
    the others revisits of it. Each attempt of a task writes files of its own
    name, and only those of attempts that succeeded are in the list.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "sha").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, top = file_at(folder)
        names = (f"{top}/p{context.partitionId():06d}-{context.taskAttemptId()}-{k:04d}.wacz" for k in range(1 << 30))
        archive, index, at = [], [], 0

        def close() -> pa.RecordBatch:
            fs.create_dir(top, recursive=True)
            name, n = next(names), len(index)
            with fs.open_output_stream(name) as out:
                for piece in Z.package([(ARCHIVE, b"".join(archive)), (INDEX, "".join(index).encode())]):
                    out.write(piece)
            archive.clear()
            index.clear()
            return pa.record_batch({"package": pa.array([f"{folder}/{name.rpartition('/')[2]}"]), "n_records": pa.array([n], pa.int64())})

        for b in batches:
            for r in b.to_pylist():
                of = digest(r["payload"])
                again = r["first"] is not None and r["page_id"] != r["first"]
                raw = _gzip(record(r["page_id"], r["url"], None if again else r["payload"], of, r["first"] if again else None))
                index.append(json.dumps({"page_id": r["page_id"], "url": r["url"], "mime": "warc/revisit" if again else "text/html", "digest": of, "offset": at, "length": len(raw), "filename": ARCHIVE}) + "\n")
                archive.append(raw)
                at += len(raw)
                if at >= PACKAGE_BYTES:
                    yield close()
                    at = 0
        if index:
            yield close()

    return stored(rows.mapInArrow(run, "package string, n_records long"), "warc-packages")


def range_records(path: str) -> Iterator[tuple[dict, bytes]]:
    """(index entry, raw record) of each record of a package, by range reads."""
    fs, name = file_at(path)
    with fs.open_input_file(name) as f:
        read = lambda at, n: f.read_at(n, at)
        members = Z.directory(read, f.size())
        index = members[INDEX]
        lines = read(Z.data_at(read, index), index.size)
        if zlib.crc32(lines) != index.crc:
            raise ValueError(f"{path}: a damaged index")
        entries = sorted((json.loads(x) for x in lines.split(b"\n") if x), key=lambda e: e["offset"])
        starts = {n: Z.data_at(read, m) for n, m in members.items() if n != INDEX}
        i = 0
        while i < len(entries):
            j, begin = i + 1, entries[i]["offset"]
            while j < len(entries) and entries[j]["filename"] == entries[i]["filename"] and entries[j]["offset"] + entries[j]["length"] - begin <= RANGE_BYTES:
                j += 1
            run = read(starts[entries[i]["filename"]] + begin, entries[j - 1]["offset"] + entries[j - 1]["length"] - begin)
            for e in entries[i:j]:
                yield e, zlib.decompress(run[e["offset"] - begin : e["offset"] - begin + e["length"]], 31)
            i = j


def read_packages(packages: DataFrame) -> DataFrame:
    """A row per record of the packages: page_id, url, record_type, refers_to, payload_digest, and the length of its own payload."""
    page = lambda x: int(x[10:-1]) if x and x.startswith("<urn:page:") else None
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("own_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("package").to_pylist():
                out = []
                for e, raw in range_records(path):
                    h, payload = parsed(raw)
                    stated = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and digest(payload) != stated:
                        raise ValueError(f"{path}: the payload of {h['warc-record-id']} isn't that of its digest")
                    out.append({"page_id": page(h["warc-record-id"]), "url": e["url"], "record_type": h["warc-type"], "refers_to": page(h.get("warc-refers-to")), "payload_digest": stated, "own_bytes": len(payload)})
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    # a package is a task's worth of work; the list itself is small
    parts = packages.sparkSession.sparkContext.defaultParallelism * 4
    return packages.select("package").repartition(parts, "package").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, own_bytes long")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Per row of ``pages``, written to packages below ``folder`` and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; empty payloads are deduplicated like others.
    A null page_id is kept: its record revisits the least page_id with the same
    payload, or is a response if there is none. Rows that repeat a page_id with
    one payload are equal records of one type. An empty table writes no package
    and gives an empty table; other columns aren't read.
    """
    packages = write_packages(pages, folder or scratch_path(pages.sparkSession, "warc"))
    records = stored(read_packages(packages), "warc-records")
    sizes = records.where("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("target"), F.col("payload_digest").alias("of"), "own_bytes").distinct()
    revisits = records.where("record_type = 'revisit'").drop("own_bytes")
    wanted = sizes.join(revisits.select(F.col("refers_to").alias("target"), F.col("payload_digest").alias("of")).distinct(), ["target", "of"], "left_semi")
    revisits = revisits.join(wanted, (revisits["refers_to"] == wanted["target"]) & (revisits["payload_digest"] == wanted["of"]))
    columns = ("page_id", F.col("own_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return records.where("record_type = 'response'").select(*columns).unionByName(revisits.select(*columns))


#: DuckDB SQL for :func:`archived`.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: right('000' || bin(strpos('0123456789abcdef', c) - 1), 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + 16 * substr(bits, 5 * k + 1, 1)::BIGINT + 8 * substr(bits, 5 * k + 2, 1)::BIGINT + 4 * substr(bits, 5 * k + 3, 1)::BIGINT
            + 2 * substr(bits, 5 * k + 4, 1)::BIGINT + substr(bits, 5 * k + 5, 1)::BIGINT)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
