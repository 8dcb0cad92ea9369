"""Stupid-backoff scores from n-gram count tables partitioned by hash.

The documents of a partition are taken in batches of consecutive rows. A batch sends
its distinct n-grams (of orders 0 to ``ORDER``, as 64-bit hashes with their
counts) to the partitions of the count table, packed: one row for a batch and
partition, so never more rows than there are distinct n-grams in the batches.
A partition sums the counts of each n-gram over all batches and joins them back
to the batches that asked, in their order. There they meet the documents, packed
as one row for each batch: they are exploded into n-grams again, each is looked
up, the document's own occurrences are taken away, and the logarithms are summed
per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import tokens as T
from tallymart.llm.common import documents, lean

_U = np.uint64
ORDER, BACKOFF = 3, 0.4
#: What a word counts that occurs in no other document.
UNSEEN = 0.5
#: Bytes of text in a batch, and n-grams (a batch and n-gram counts once) in a partition of the count table, on average.
BATCH_BYTES, TABLE_ROWS = 8 << 20, 3_000_000


def _pack(x: np.ndarray) -> bytes:
    """Bytes of unsigned integers, plane by plane, so that the rarely used high bytes vanish in compression."""
    planes = x.view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack_keys(sorted_keys: np.ndarray) -> bytes:
    """Ascending keys as packed differences."""
    return _pack(np.diff(sorted_keys, prepend=_U(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, _U), dtype=_U)


class Grams:
    """The n-grams of a batch of texts: word hashes, the document of each word, and the n-gram of each order that ends at each word."""

    def __init__(self, column: pa.Array) -> None:
        hashes, owner, counts = [], [], []
        for w in T.words(column):
            hashes.append(w.hashes)
            sizes = np.diff(w.bounds)
            owner.append(np.repeat(np.arange(w.first, w.first + len(sizes)), sizes))
            counts.append(sizes)
        none = np.zeros(0, dtype=np.int64)
        self.words = np.concatenate(hashes) if hashes else none.astype(_U)
        self.owner = np.concatenate(owner) if owner else none
        self.n_words = np.concatenate(counts) if counts else none
        n = len(self.words)
        first = np.concatenate([[0], np.cumsum(self.n_words)])[:-1]
        self.place = np.arange(n) - first[self.owner]  # of a word in its document
        self.keys, self.valid = [], []
        for k in range(1, ORDER + 1):
            key = np.zeros(n, dtype=_U)
            if n >= k:
                key[k - 1 :] = T.mix(T.ngrams(self.words, k) + _U(k))
            self.keys.append(key)
            self.valid.append(self.place >= k - 1)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys that occur, ascending, and their counts; key 0 stands for all words."""
        every = np.concatenate([k[v] for k, v in zip(self.keys, self.valid, strict=True)])
        keys, counts = np.unique(every, return_counts=True)
        return np.concatenate([[_U(0)], keys]), np.concatenate([[len(self.words)], counts])

    def held_out(self, k: int, keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """For the order-k n-gram ending at each word its count outside the word's document; 0 where there is none."""
        out = np.zeros(len(self.words), dtype=np.int64)
        at = np.flatnonzero(self.valid[k - 1])
        if len(at):
            which = np.searchsorted(keys, self.keys[k - 1][at])
            code = self.owner[at] * len(keys) + which
            _, inverse, own = np.unique(code, return_inverse=True, return_counts=True)
            out[at] = totals[which] - own[inverse]
        return out


def _scores(g: Grams, keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The logarithm of each word's stupid-backoff score."""
    n = len(g.words)
    others = totals[0] - g.n_words[g.owner]  # words of all other documents
    one = g.held_out(1, keys, totals)
    score = np.where(one > 0, one, UNSEEN) / np.maximum(others, 1)
    context = one
    for k in range(2, ORDER + 1):
        now = g.held_out(k, keys, totals)
        before = np.zeros(n, dtype=np.int64)
        before[1:] = context[:-1]  # the count of what precedes the word
        has = g.valid[k - 1]
        score = np.where(has & (now > 0), now / np.maximum(before, 1), np.where(has, BACKOFF * score, score))
        context = now
    return np.log(score)


def lm_scores(docs: DataFrame, table_rows: int = TABLE_ROWS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, log_score (sum over its words), mean_score (per word).

    Words are runs of bytes other than white space, A-Z as a-z. Each word is
    scored by the counts of all other documents: the trigram's count over that
    of its first two words; where it is 0, ``BACKOFF`` times the bigram's over
    its first word's; then the word's over all words. A word that occurs
    nowhere else counts ``UNSEEN``. Words at the start have fewer words before
    them and lose no factor for it.

    Null or empty text: no words, log_score 0, mean_score null. Null doc_id and
    repeated rows: every row is a document of its own. Texts of any length are
    taken whole; one above ``BATCH_BYTES`` is a batch by itself. An empty table
    gives an empty table; other columns aren't read. ``docs`` is read twice and
    must come in the same order, as a stored table does; otherwise the job fails.
    """
    docs = documents(docs)
    # words have six bytes or so, and each ends ORDER n-grams
    parts = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * ORDER // (6 * table_rows)))

    def send(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs in _batches(some, batch_bytes):
            keys, counts = Grams(docs.column("text")).distinct()
            ends = _ends(keys, parts)
            found = [(p, _pack_keys(keys[a:b]), _pack(counts[a:b].astype("<u4"))) for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a]
            p, k, c = zip(*found, strict=True)
            yield pa.record_batch({"batch": pa.array([batch] * len(p), pa.int64()), "part": pa.array(p, pa.int64()), "keys": pa.array(k, pa.binary()), "counts": pa.array(c, pa.binary())})

    def pack(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(some, batch_bytes)

    def count(key: tuple[pa.Scalar, ...], some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(r["batch"], _unpack_keys(r["keys"]), _unpack(r["counts"], "<u4")) for b in some for r in b.to_pylist()]
        keys, inverse = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate([c for _, _, c in asked]), minlength=len(keys)).astype("<u8")
        at = np.cumsum([0, *(len(k) for _, k, _ in asked)])
        for (batch, _, _), a, b in zip(asked, at, at[1:], strict=False):
            yield pa.record_batch({"batch": pa.array([batch], pa.int64()), "part": pa.array([key[0].as_py()], pa.int64()), "totals": pa.array([_pack(totals[inverse[a:b]])], pa.binary())})

    def score(key: tuple[pa.Scalar, ...], own: pa.Table, counted: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(counted.column("part").to_numpy())
        found = counted.column("totals").to_pylist()
        totals = np.concatenate([_unpack(found[i], "<u8") for i in order]).astype(np.int64)
        for packed_docs in own.column("docs"):  # one: a batch is one row
            docs = _opened(packed_docs)
            g = Grams(docs.column("text"))
            keys, _ = g.distinct()
            if len(keys) != len(totals):
                raise ValueError("the documents were dealt otherwise when they were read again: store them first")
            sums = np.bincount(g.owner, weights=_scores(g, keys, totals), minlength=len(g.n_words)) if len(g.words) else np.zeros(len(g.n_words))
            mean = pa.array(sums / np.maximum(g.n_words, 1), mask=g.n_words == 0)
            out.append(pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(g.n_words, pa.int64()), "log_score": pa.array(sums), "mean_score": mean}))
        return pa.concat_tables(out)

    sent = docs.mapInArrow(lean(send), "batch long, part long, keys binary, counts binary")
    table = sent.groupBy("part").applyInArrow(lean(count), "batch long, part long, totals binary")
    whole = docs.mapInArrow(lean(pack), "batch long, docs binary")
    scored = whole.groupBy("batch").cogroup(table.groupBy("batch"))
    return scored.applyInArrow(score, "doc_id long, n_words long, log_score double, mean_score double")


def _batches(some: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of a partition of about ``most`` bytes of text, numbered over all partitions."""
    batch = TaskContext.get().partitionId() << 33
    waiting: list[pa.RecordBatch] = []
    size = 0
    for b in some:
        offsets, _ = T.string_parts(b.column("text"))
        for i, j in T.slices(offsets, most):
            new = int(offsets[j] - offsets[i])
            if waiting and size + new > most:
                yield batch, pa.Table.from_batches(waiting).combine_chunks()
                batch, waiting, size = batch + 1, [], 0
            waiting.append(b.slice(i, j - i))
            size += new
    if waiting:
        yield batch, pa.Table.from_batches(waiting).combine_chunks()


def packed(some: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(batch, docs): each batch as a compressed Arrow table."""
    for batch, docs in _batches(some, most):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(docs)
        yield pa.record_batch({"batch": pa.array([batch], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _opened(docs: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(docs.as_buffer()).read_all()


def _ends(keys: np.ndarray, parts: int) -> list[int]:
    """Where each partition's keys end: partitions are equal ranges of the hash, so ascending keys pass through them in order."""
    cuts = [((p + 1) << 64) // parts for p in range(parts - 1)]
    return [*np.searchsorted(keys, np.array(cuts, dtype=_U)).tolist(), len(keys)]


#: DuckDB SQL for the query, whose scores are rounded.
ORACLE = """
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t),
g AS (SELECT doc_id, i, w AS w1, lag(w) OVER o || ' ' || w AS w2, lag(w, 2) OVER o || ' ' || lag(w) OVER o || ' ' || w AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY doc_id, w1) AS c1,
  CASE WHEN w2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w2) - count(*) OVER (PARTITION BY doc_id, w2) END AS c2,
  CASE WHEN w3 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY doc_id, w3) END AS c3,
  greatest(1, count(*) OVER () - count(*) OVER (PARTITION BY doc_id)) AS n FROM g),
p AS (SELECT *, lag(c1) OVER o AS p1, lag(c2) OVER o AS p2 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT *, CASE WHEN c1 > 0 THEN c1 ELSE 0.5 END::DOUBLE / n AS s1 FROM p),
b AS (SELECT *, CASE WHEN w2 IS NULL THEN s1 WHEN c2 > 0 THEN c2::DOUBLE / p1 ELSE 0.4::DOUBLE * s1 END AS s2 FROM a),
s AS (SELECT doc_id, ln(CASE WHEN w3 IS NULL THEN s2 WHEN c3 > 0 THEN c3::DOUBLE / p2 ELSE 0.4::DOUBLE * s2 END) AS l FROM b),
x AS (SELECT doc_id, count(*)::BIGINT AS n_words, sum(l) AS l FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(x.n_words, 0) AS n_words, round(coalesce(x.l, 0), 4) AS log_score, round(x.l / x.n_words, 6) AS mean_score
FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id
"""
