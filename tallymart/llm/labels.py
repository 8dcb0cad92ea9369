"""Labelled samples and logistic calibration for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; -1 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, rows: int, longest: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most ``rows`` training rows of each class, and the size of each class among all of them.

    Training rows are those whose fold isn't ``held_out``; the choice goes by a
    hash of the doc_id. Texts above ``longest`` bytes and rows whose doc_id or
    label is null stay out of the sample. A doc_id with labels of both kinds
    counts for either.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    some = some.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(folds) != held_out)).distinct()
    sizes = {r["label"]: r["count"] for r in some.groupBy("label").count().collect()}
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = some.where("label = 1").orderBy(*by_hash).limit(rows).unionByName(some.where("label = 0").orderBy(*by_hash).limit(rows))
    # at most 2 * rows ids of 12 bytes
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = found.join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= longest)
    return found.select("doc_id", "text", "label"), sizes


class Logistic:
    """Ridge logistic regression on standardised columns, fitted by Newton's method.

    Values beyond those of the fit are taken as the nearest of them.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        a = self._design(x)
        self.w = np.zeros(a.shape[1])
        penalty = np.full(a.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ self.w, -30, 30)))
            gradient = a.T @ (weight * (p - y)) + penalty * self.w
            step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty), gradient)
            self.w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-7:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (np.clip(x, self.low, self.high) - self.mean) / self.scale])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.w, -30, 30)))
