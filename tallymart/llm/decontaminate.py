"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over token positions; tokens under a 0 of the mask don't
enter the hash, so a substitution there leaves the hash as it is. Hashes of all
benchmark windows are joined with those of all document windows; around each
hit the whole item is laid along the document and the substitution-tolerant
overlap is measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import tokens as T
from tallymart.llm.common import stored

_U = np.uint64
#: Fixed masks: 1 is a token that enters the hash, 0 one that may differ.
MASKS = ("11111", "111011", "1101011", "1100111", "11010011", "1010101001")
#: Masks besides them for items of fewer than LEAST_TOKENS tokens, whose every substitution must leave a hit.
SHORT_MASKS = ("01111", "10111", "11011", "11101", "11110")
#: An overlap counts from so many tokens (the whole item, if it has fewer), of which so many in a hundred agree.
LEAST_TOKENS, LEAST_PERCENT = 13, 80
#: Bits of the filter of benchmark hashes that goes to every task: 2**FILTER_BITS (2 MB), whatever the benchmark's size.
FILTER_BITS = 24
_PER_PIECE = 1 << 17  # bytes of a piece of the filter

_BREAKS = np.ones(256, dtype=bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def token_hashes(column: pa.Array) -> Iterator[T.Words]:
    """Hashes of runs of letters and digits, case folded; other ASCII characters part them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return T.words(pc.utf8_lower(column.fill_null("")), _BREAKS)


def seeds(hashes: np.ndarray, short: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """For each mask (``short``: those of short items too) its number and the hash of the window that begins at each token."""
    for k, mask in enumerate(MASKS + SHORT_MASKS if short else MASKS):
        n = len(hashes) - len(mask) + 1
        if n > 0:
            yield k, T.mix(T.combined([hashes[i : i + n] for i, c in enumerate(mask) if c == "1"]) + _U(k + 1))


def _whole(hashes: np.ndarray) -> np.ndarray:
    """The hash of a token sequence that is shorter than any mask."""
    return T.mix(T.combined([hashes[i : i + 1] for i in range(len(hashes))]) + _U(1000 + len(hashes)))


SHORTEST = min(map(len, MASKS))


def item_seeds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, item_id, at) of every window of every item, and (item_id, tokens): hashes of the item's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w in token_hashes(b.column("text")):
                out += [w.hashes[w.bounds[i] : w.bounds[i + 1]].view(np.int64) for i in range(len(w.bounds) - 1)]
            yield pa.record_batch({"item_id": b.column("item_id"), "tokens": pa.array(out, pa.list_(pa.int64()))})

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, tokens in zip(b.column("item_id"), b.column("tokens"), strict=True):
                t = tokens.values.to_numpy().view(_U)
                found = [h for _, h in seeds(t, len(t) < LEAST_TOKENS)] if len(t) >= SHORTEST else [_whole(t)]
                at = np.concatenate([np.arange(len(h)) for h in found])
                yield pa.record_batch({"hash": pa.array(np.concatenate(found).view(np.int64)), "item_id": pa.array([item.as_py()] * len(at), pa.int64()), "at": pa.array(at, pa.int64())})

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = items.where("item_id IS NOT NULL").dropDuplicates()
    items = stored(items.mapInArrow(run, "item_id long, tokens array<long>").where("size(tokens) > 0"), "bench-items")
    return stored(items.mapInArrow(windows, "hash long, item_id long, at long").dropDuplicates(), "bench-seeds"), items


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash, by its top FILTER_BITS bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for b in batches:
            bits[(b.column("hash").to_numpy().view(_U) >> _U(64 - FILTER_BITS)).astype(np.int64)] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, _PER_PIECE)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.record_batch({"piece": pa.array(some, pa.int64()), "bits": pa.array([packed[k].tobytes() for k in some], pa.binary())})

    def either(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_PER_PIECE, dtype=np.uint8)
        for b in rows:
            for x in b.column("bits"):
                total |= np.frombuffer(x.as_buffer(), dtype=np.uint8)
        yield pa.record_batch({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8).reshape(-1, _PER_PIECE)
    for r in hashes.select("hash").mapInArrow(run, "piece long, bits binary").groupBy("piece").applyInArrow(either, "piece long, bits binary").collect():
        out[r["piece"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def _document_hits(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """Of each document with a window whose hash passes the filter: text and all (hash, at) of such windows.

    ``short``: lengths of the items below LEAST_TOKENS; those below every mask are looked for as whole sequences.
    """
    masks, whole = MASKS + SHORT_MASKS, [n for n in short if n < SHORTEST]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def passing(h: np.ndarray) -> np.ndarray:
        top = (h >> _U(64 - FILTER_BITS)).astype(np.int64)
        return np.flatnonzero((shared.value[top >> 3] >> (top & 7).astype(np.uint8)) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            for w in token_hashes(text):
                owner = np.searchsorted(w.bounds, np.arange(len(w.hashes)), "right") - 1
                found = []
                for h, span in [*((h, len(masks[k])) for k, h in seeds(w.hashes, len(whole) < len(short))), *((T.mix(T.combined([w.hashes[i : len(w.hashes) - n + 1 + i] for i in range(n)]) + _U(1000 + n)), n) for n in whole if len(w.hashes) >= n)]:
                    at = passing(h)
                    at = at[owner[at] == owner[at + span - 1]]
                    found.append((at, h[at]))
                if not found or not sum(len(a) for a, _ in found):
                    continue
                at, h = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(owner[at], kind="stable")
                at, h = at[order], h[order]
                own, first = np.unique(owner[at], return_index=True)
                cuts = pa.array([*first, len(at)], pa.int32())
                rows = pa.array(own + w.first)
                hits = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(at - w.bounds[owner[at]], pa.int64())], ["hash", "at"])
                yield pa.record_batch({"doc_id": b.column("doc_id").take(rows), "text": text.take(rows).cast(pa.string()), "hits": pa.ListArray.from_arrays(cuts, hits)})

    return docs.mapInArrow(run, "doc_id long, text string, hits array<struct<hash:long,at:long>>")


def best_overlap(item: np.ndarray, doc: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(start in the document, tokens, agreeing tokens) of the longest stretch, with the item laid at ``shift``, that agrees in LEAST_PERCENT of its tokens and begins and ends in agreement; a short item counts as a whole or not at all."""
    if len(item) < LEAST_TOKENS:
        if shift < 0 or shift + len(item) > len(doc):
            return 0, 0, 0
        n = int((item == doc[shift : shift + len(item)]).sum())
        return (shift, len(item), n) if 100 * n >= LEAST_PERCENT * len(item) else (0, 0, 0)
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high <= low:
        return 0, 0, 0
    same = item[low:high] == doc[low + shift : high + shift]
    # stretch i..j counts if 100 * agreeing >= LEAST_PERCENT * tokens: prefix value at j+1 not below that at i
    value = np.concatenate([[0], np.cumsum(np.where(same, 100 - LEAST_PERCENT, -LEAST_PERCENT))])
    ends = np.flatnonzero(same)
    if len(ends) == 0:
        return 0, 0, 0
    # the least i whose prefix value is no higher than that at the end: running minima fall, so they can be searched
    least = np.minimum.accumulate(value[:-1])
    begin = np.searchsorted(-least, -value[ends + 1])
    # from there to the next token that agrees, the value only falls
    begin = ends[np.searchsorted(ends, begin)]
    k = int(np.argmax(ends + 1 - begin))
    i, j = int(begin[k]), int(ends[k])
    return low + shift + i, j + 1 - i, int(same[i : j + 1].sum())


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_same, text) of each document and item that overlap, at the longest overlap.

    An overlap is a stretch of at least ``LEAST_TOKENS`` tokens, or the whole
    item if that is shorter, of which ``LEAST_PERCENT`` in a hundred agree with
    the document in place; ``start`` is its first token there.

    Null and empty texts overlap with nothing, nor do items without tokens or
    with a null item_id. A null doc_id is kept as it is. Repeated rows: each has
    its result. Of equally long overlaps the first in the document is given.
    Empty tables give an empty table; other columns aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashes, items = item_seeds(benchmark)
    short = sorted(r[0] for r in items.where(F.size("tokens") < LEAST_TOKENS).select(F.size("tokens")).distinct().collect())
    # row_id is stable: the table is stored once
    hits = stored(_document_hits(docs, _filter(hashes), short).withColumn("row_id", F.monotonically_increasing_id()), "bench-hits")
    met = hits.select("row_id", F.inline("hits")).withColumnRenamed("at", "doc_at").join(hashes, "hash")
    laid = met.select("row_id", "item_id", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    laid = laid.groupBy("row_id", "item_id").agg(F.collect_set("shift").alias("shifts"))
    laid = laid.join(items, "item_id").join(hits.select("row_id", "doc_id", "text"), "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = [w.hashes[w.bounds[i] : w.bounds[i + 1]] for w in token_hashes(b.column("text")) for i in range(len(w.bounds) - 1)]
            out = []
            for d, tokens, shifts in zip(doc, b.column("tokens"), b.column("shifts"), strict=True):
                item = tokens.values.to_numpy().view(_U)
                # no shift twice: overlapping stretches of one shift are one
                out.append(min((best_overlap(item, d, s) for s in shifts.as_py()), key=lambda x: (-x[1], x[0])) + (len(item),))
            start, n, same, size = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True)) if out else [np.zeros(0, dtype=np.int64)] * 4
            keep = pa.array(n >= np.minimum(LEAST_TOKENS, size))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "item_id": b.column("item_id"), "start": pa.array(start), "n_tokens": pa.array(n), "n_same": pa.array(same), "text": b.column("text")}).filter(keep)

    return laid.select("doc_id", "item_id", "text", "tokens", "shifts").mapInArrow(run, "doc_id long, item_id long, start long, n_tokens long, n_same long, text string")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that overlap with no item; nulls as in :func:`overlaps`."""
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.xxhash64("text").alias("bad_text")).distinct()
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (own == bad["bad_text"]), "left_anti")
