"""Media columns stored as content-defined chunks.

A payload becomes 8-bit samples of a WAVE file. The file is cut where a rolling
gear hash of its last bytes meets a mask, so equal stretches give equal chunks
wherever they stand. Chunk digests are counted and deduplicated in Spark: a
chunk that occurs once stays in the row of its file, one that occurs more often
is stored once in a chunk table; every file is an ordered list of chunks.
Reading back joins the lists with the chunk table, verifies the digest of each
whole file, and computes features from the samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import tokens as T
from tallymart.llm.common import stored

_U = np.uint64
#: Chunks have between so many bytes, and about AVERAGE beyond the least (the last may be shorter).
LEAST, AVERAGE, MOST = 1 << 10, 1 << 12, 1 << 15
UNIT, RATE = 64, 8000
_WINDOW = 64
#: Bits of the filter of repeated chunk digests (2 MB), whatever the size of the corpus.
FILTER_BITS = 24
_PIECE = 1 << 17  # bytes of a piece of the filter
_GEAR = T.mix(np.arange(257, 513, dtype=_U))


def wave(payload: bytes) -> bytes:
    """A mono WAVE file whose 8-bit samples are the payload (an even number of bytes, below 4 GiB)."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of a file made by :func:`wave`."""
    riff, _, kind, _, _, code, channels, _, _, _, bits, mark, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, kind, mark, code, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 1, 8) or len(media) != 44 + n:
        raise ValueError("not such a file")
    return media[44:]


def payload_of(text: bytes) -> bytes:
    """The text and bytes 0 up to a positive multiple of 64."""
    return text + bytes((-len(text)) % UNIT or (0 if text else UNIT))


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of some bytes.

    The gear hash of a place is the sum of the gear of each of the last 64
    bytes, shifted by its age; a bit shifted out is gone, so it is the sum of
    64 shifted columns and all places are hashed at once, piece by piece.
    """
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    mask = _U((AVERAGE - 1) << (64 - AVERAGE.bit_length() + 1))
    found = []
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, n, 1 << 20):
        low = max(0, at - _WINDOW + 1)
        h = _GEAR[raw[low : at + (1 << 20)]]
        span = 1
        while span < _WINDOW:  # doubling: the hash of the last 2 * span bytes from two of the last span
            h[span:] = h[span:] + (h[:-span] << _U(span))
            span *= 2
        found.append(np.flatnonzero((h[at - low :] & mask) == 0) + at + 1)
    places = np.concatenate(found)
    out, begin = [], 0
    while n - begin > LEAST:
        k = int(np.searchsorted(places, begin + LEAST))
        end = min(int(places[k]) if k < len(places) else n, begin + MOST, n)
        out.append(end)
        begin = end
    if begin < n:
        out.append(n)
    return out


def features(data: bytes) -> str:
    """Mean, deviation, zero crossings and envelope of 8-bit samples, from integers only."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    total, square = int(x.sum()), int((x * x).sum())
    edges = [len(x) * k // 8 for k in range(9)]
    envelope = [int(x[a:b].max()) if b > a else 0 for a, b in zip(edges, edges[1:], strict=False)]
    return f"sum={total};square={square};crossings={crossings};peaks={','.join(map(str, envelope))}"


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[int]]]:
    """Of each row: length of the text, the file, the ends of its chunks."""
    at, data = T.string_parts(b.column("text"))
    for i in range(len(at) - 1):
        whole = wave(payload_of(data[at[i] : at[i + 1]].tobytes()))
        yield int(at[i + 1] - at[i]), whole, cuts(whole)


def digests(docs: DataFrame) -> DataFrame:
    """(digest) of each chunk of each row with ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [hashlib.sha256(whole[x:y]).digest() for _, whole, ends in _chunks(b) for x, y in zip([0, *ends], ends, strict=False)]
            yield pa.record_batch({"digest": pa.array(out, pa.binary())})

    return docs.select("text").mapInArrow(run, "digest binary")


def _filter(shared: DataFrame) -> np.ndarray:
    """A bit for each digest, by its first FILTER_BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for b in batches:
            bits[[_place(x) for x in b.column("digest").to_pylist()]] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, _PIECE)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.record_batch({"piece": pa.array(some, pa.int64()), "bits": pa.array([packed[k].tobytes() for k in some], pa.binary())})

    def either(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_PIECE, dtype=np.uint8)
        for b in rows:
            for x in b.column("bits"):
                total |= np.frombuffer(x.as_buffer(), dtype=np.uint8)
        yield pa.record_batch({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8).reshape(-1, _PIECE)
    for r in shared.mapInArrow(run, "piece long, bits binary").groupBy("piece").applyInArrow(either, "piece long, bits binary").collect():
        out[r["piece"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def _place(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - FILTER_BITS)


_CHUNKS = "array<struct<digest:binary,size:bigint,data:binary>>"


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store the media of ``docs`` (doc_id, text): the files and the chunks that several share, as written tables.

    files: a row for each row of ``docs``: doc_id, n_bytes, media (digest of the
    file), chunks (ordered: digest, size, and the bytes unless shared), shared
    (whether any is). chunks: digest and bytes, one row for each shared digest.

    A digest counts as shared if it occurs twice, which a filter of fixed size
    tells every task; a chance hit of the filter only moves a chunk's bytes
    from its file to the chunk table.
    """
    repeated = digests(docs).groupBy("digest").count().where("count > 1").select("digest")
    bits = docs.sparkSession.sparkContext.broadcast(_filter(repeated))  # 2**FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # shared chunks that this task has sent
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                out = []
                for doc_id, (n, whole, ends) in zip(ids[i : i + 512], _chunks(part), strict=True):
                    chunks, some = [], False
                    for x, y in zip([0, *ends], ends, strict=False):
                        data = whole[x:y]
                        own = hashlib.sha256(data).digest()
                        k = _place(own)
                        common = bool(bits.value[k >> 3] >> (k & 7) & 1)
                        some |= common
                        chunks.append({"digest": own, "size": y - x, "data": None if common else data})
                        if common and own not in seen:
                            if len(seen) < 100_000:
                                seen.add(own)
                            out.append({"kind": 1, "chunks": [{"digest": own, "size": y - x, "data": data}]})
                    out.append({"kind": 0, "doc_id": doc_id, "n_bytes": n, "media": hashlib.sha256(whole).digest(), "shared": some, "chunks": chunks})
                yield pa.RecordBatch.from_pylist(out, _ROW)

    rows = stored(docs.mapInArrow(run, f"kind int, doc_id long, n_bytes long, media binary, shared boolean, chunks {_CHUNKS}"), "media-files")
    chunks = rows.where("kind = 1").select(F.col("chunks")[0]["digest"].alias("digest"), F.col("chunks")[0]["data"].alias("data"))
    return rows.where("kind = 0").drop("kind"), stored(chunks.dropDuplicates(["digest"]), "media-chunks")


_ROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("shared", pa.bool_()), ("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int64()), ("data", pa.binary())])))])
_RESULT = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def restored(files: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of each file and what is computed from it, as put together from its chunks and verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for media, chunks in zip(b.column("media"), b.column("chunks"), strict=True):
                whole = b"".join(c["data"] for c in chunks.as_py())
                digest = hashlib.sha256(whole).digest()
                if digest != media.as_py():
                    raise ValueError("a file doesn't have the digest that it was stored with")
                payload = samples(whole)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(whole), digest.hex(), features(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.record_batch([*(b.column(k) for k in keep), *made], names=[*keep, *(x.split()[0] for x in _RESULT.split(", "))])

    kept = ", ".join(f"{k} {t}" for k, t in files.select(*keep).dtypes)
    return files.select(*dict.fromkeys([*keep, "media", "chunks"])).mapInArrow(run, f"{kept}, {_RESULT}")


def stored_media(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    All but n_bytes are computed from the file as read back from its chunks.
    Null or empty text: 64 bytes 0. Null doc_id and repeated rows: each row has
    its result; rows with equal texts share one file. An empty table gives an
    empty table; other columns aren't read.
    """
    files, chunks = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    alone = restored(files.where("NOT shared"), "doc_id", "n_bytes")
    # files with shared chunks: one of each kind is put together, and its results go to all rows that have it
    parts = files.where("shared").dropDuplicates(["media"]).select("media", F.posexplode("chunks").alias("pos", "c"))
    own = parts.where("c.data IS NOT NULL").select("media", "pos", "c.digest", "c.data")
    lent = parts.where("c.data IS NULL").select("media", "pos", "c.digest").join(chunks, "digest").select("media", "pos", "digest", "data")
    whole = own.unionByName(lent).groupBy("media").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "data"))).alias("chunks"))
    made = stored(restored(whole, "media"), "media-results")
    rest = files.where("shared").select("doc_id", "n_bytes", "media").join(made, "media").drop("media")
    return alone.unionByName(rest)
