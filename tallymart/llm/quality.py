"""Compression classifier of text quality.

Two zstandard dictionaries are trained, one on texts labelled good and one on
texts labelled bad. A text is compressed whole with each; the difference of the
two sizes, normalised by the larger, says whose phrases it shares. The
compressed share of the text and its length go into the calibration beside it,
for texts that repeat words of their own say little about either dictionary.
Calibration is a logistic fit on rows that the dictionaries haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm import tokens as T
from tallymart.llm.common import documents
from tallymart.llm.labels import Logistic, fold, labelled_sample

#: Bound of the training sample: rows of each class, bytes of a text, bytes of a class for its dictionary.
SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_BYTES = 3000, 1 << 17, 6 << 20
DICTIONARY, LEVEL, PIECE = 112 << 10, 3, 2048


class Model(NamedTuple):
    good: bytes
    bad: bytes
    raw: bool  # too few texts to train on: the dictionaries are plain texts
    fit: Logistic | None
    prior: float


def _dictionary(texts: list[bytes], raw: bool) -> bytes:
    pieces, total = [], 0
    for x in texts:
        if total > SAMPLE_BYTES:
            break
        pieces += [x[i : i + PIECE] for i in range(0, len(x), PIECE)]
        total += len(x)
    if raw:
        return b"\n".join(pieces)[-DICTIONARY:]
    return zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()


class Sizes:
    """Compressed sizes of texts with either dictionary."""

    def __init__(self, model: Model) -> None:
        kind = zstandard.DICT_TYPE_RAWCONTENT if model.raw else zstandard.DICT_TYPE_FULLDICT
        self.by = []
        for x in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(x, dict_type=kind) if x else None
            if d is not None:
                d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))

    def __call__(self, texts: Iterator[bytes]) -> np.ndarray:
        return np.array([(len(x), len(self.by[0].compress(x)), len(self.by[1].compress(x))) for x in texts], dtype=float).reshape(-1, 3)


def evidence(sizes: np.ndarray, raw: bool) -> np.ndarray:
    """The normalised difference, the compressed share, the length, and (unless few texts were there) their products."""
    n, good, bad = sizes.T
    d = (bad - good) / np.maximum(1, np.maximum(good, bad))
    share = np.log((np.minimum(good, bad) + 8) / (n + 8))
    length = np.log1p(n)
    if raw:
        return np.column_stack([d, share, length])
    return np.column_stack([d, share, length, d * d, share * share, length * length, d * share, d * length, share * length])


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """Dictionaries and calibration from at most ``SAMPLE_ROWS`` labelled rows of each class outside the held-out fold."""
    sample, sizes = labelled_sample(docs, labels, "quality", folds, held_out, SAMPLE_ROWS, SAMPLE_TEXT)
    rows = sorted({(r["doc_id"], r["text"], r["label"]) for r in sample.collect()})
    order = np.random.default_rng(7).permutation(len(rows))
    texts = {k: [rows[i][1].encode() for i in order if rows[i][2] == k] for k in (0, 1)}
    prior = (sizes.get(1, 0) + 1) / (sizes.get(0, 0) + sizes.get(1, 0) + 2)
    if not texts[0] or not texts[1]:
        return Model(b"", b"", True, None, prior)
    raw = min(len(texts[0]), len(texts[1])) < 200
    model = Model(_dictionary(texts[1][::2], raw), _dictionary(texts[0][::2], raw), raw, None, prior)
    size = Sizes(model)
    rest = {k: texts[k][1::2] or texts[k] for k in (0, 1)}
    x = evidence(np.concatenate([size(rest[0]), size(rest[1])]), raw)
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    share = np.where(y == 1, prior, 1 - prior) / np.where(y == 1, y.mean(), 1 - y.mean())
    return model._replace(fit=Logistic(x, y, share))


def score_quality(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: good likelier), predicted (1 if score >= threshold).

    Null text counts as empty; an empty text has the score of its sizes like any
    other. Null doc_id: scored, not held out. Repeated rows: each is scored.
    Without labels of both kinds every score is the share of good labels,
    smoothed. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        size = Sizes(m)
        for b in batches:
            at, data = T.string_parts(b.column("text"))
            sizes = size(data[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1))
            p = m.fit(evidence(sizes, m.raw)) if m.fit is not None else np.full(len(sizes), m.prior)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    rows = documents(docs).select("doc_id", "text", (fold(folds) == held_out).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        size = Sizes(m)
        for b in batches:
            at, data = T.string_parts(b.column("text"))
            sizes = size(data[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1))
            p = m.fit(evidence(sizes, m.raw)) if m.fit is not None else np.full(len(sizes), m.prior)
            yield b.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
