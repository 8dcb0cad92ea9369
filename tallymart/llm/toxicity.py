"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon holds words, and stems that also match the beginnings of words. It
is learned from labelled rows: a word or stem enters if it occurs in toxic
texts so much more often than elsewhere that chance can't explain it among all
that were tried. Every distinct word of a text is matched by running the
Levenshtein automaton of the word through the tries: states are rows of edit
distances, and a branch is left as soon as all its distances exceed the limit.
A word's entry is reached at the end of the row, a stem at any place of it.
Hits in a context window of quotation or report weigh less than plain ones, and
those beside an address weigh more. The weights add up to a calibrated score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import documents, lean, stored
from tallymart.llm.labels import Logistic, fold, labelled_sample

#: Bound of the training sample: rows of each class, bytes of a text.
SAMPLE_ROWS, SAMPLE_TEXT = 12_000, 1 << 17
#: Rows of each class of that sample on which the score is calibrated.
CALIBRATION_ROWS = 1500
#: Stems have between so many characters.
STEM = (4, 7)
#: Edits allowed from so many characters of an entry on, and how many more a stem must have for them, as what follows it is free.
ONE_EDIT, TWO_EDITS, FREE = 5, 9, 2
#: Words kept by a worker with their match before it starts anew; longer ones than KEPT_WORD are matched each time.
KEPT, KEPT_WORD = 100_000, 64
#: Characters on either side of a hit that are its context, and what context and kind of match do to its weight.
WINDOW, QUOTED, REPORTED, ADDRESSED, MISSPELT = 48, 0.3, 0.5, 1.25, 0.7

#: Words with a prior: little evidence lets them in, and they serve where no toxic labels are there to learn from.
PLAIN = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting", "imbecile", "bastard", "asshole", "bitch", "retard", "vermin", "filth", "dumbass")
WORD = regex.compile(r"[^\W_]+")
_REPORT = regex.compile(r"\b(?:said|says|wrote|writes|quote[sd]?|quoting|according|called|term|word|insult|slur|sagte|schrieb|zitat|dit|écrit|citation|dijo|escribió|cita)\b")
_ADDRESS = regex.compile(r"\b(?:you|your|you're|ur|du|dein|ihr|tu|toi|vous|tú|usted|eres)\b")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"


class Trie:
    """Lexicon tries by the parts of their entries.

    Of k + 1 parts of an entry one is left whole by k edits, so a word needs
    only the tries of the parts that it begins with, ends with, or holds. A node
    is its children by character, under "" the entry that ends there, and under
    "most" the edits that an entry below allows.
    """

    def __init__(self, weights: dict[str, float], stems: dict[str, float]) -> None:
        self.weights, self.stems = weights, stems
        self.heads: dict[str, dict] = {}
        self.tails: dict[str, dict] = {}
        self.middles: dict[str, dict] = {}
        self.starts: dict = {}
        for s in stems:
            self._add(self.starts, "", s, edits(len(s) - FREE))
        self.longest_stem = max(map(len, stems), default=0)
        lengths: set[int] = set()
        for w in weights:
            k = edits(len(w))
            if not k:
                continue  # only itself is meant
            part = len(w) // (k + 1)
            lengths.update(range(len(w) - k, len(w) + k + 1))
            self._add(self.heads, w[:part], w, k)
            self._add(self.tails, w[k * part :], w, k)
            if k == 2:
                self._add(self.middles, w[part : 2 * part], w, k)
        self.lengths = frozenset(lengths)
        self.head_sizes = sorted({len(x) for x in self.heads})
        self.tail_sizes = sorted({len(x) for x in self.tails})

    @staticmethod
    def _add(tries: dict[str, dict], part: str, entry: str, k: int) -> None:
        node = tries.setdefault(part, {})
        for c in entry:
            node = node.setdefault(c, {})
            node["most"] = max(k, node.get("most", 0))
        node[""] = entry

    def roots(self, word: str) -> list[dict]:
        """The tries of which an entry may lie within its edits of the word."""
        if len(word) not in self.lengths:
            return []
        found = [r for k in self.head_sizes if (r := self.heads.get(word[:k]))]
        found += [r for k in self.tail_sizes if (r := self.tails.get(word[-k:]))]
        return found + [r for m, r in self.middles.items() if m in word]

    def nearest(self, word: str) -> tuple[int, str] | None:
        """(distance, entry) of the least distance within the edits that the entry allows; ties go to the heavier, then the first entry.

        The Levenshtein automaton of the word runs through each trie: its state
        is the row of distances between the beginnings of the word and the path.
        """
        best: tuple[int, float, str] | None = None
        first = list(range(len(word) + 1))
        rows = [(root, first) for root in self.roots(word)]
        while rows:
            node, row = rows.pop()
            for c, child in node.items():
                if not c:
                    if row[-1] <= edits(len(child)):
                        found = row[-1], -self.weights[child], child
                        best = found if best is None else min(best, found)
                    continue
                if len(c) != 1:
                    continue
                new = _next(row, word, c)
                if min(new) <= child["most"]:
                    rows.append((child, new))
        return (best[0], best[2]) if best else None


    def beginning(self, word: str) -> tuple[int, str] | None:
        """(distance, stem) of the stem that is nearest to a beginning of the word, within the edits that the stem allows; ties as in :meth:`nearest`."""
        if not self.starts:
            return None
        start = word[: self.longest_stem + 2]
        best: tuple[int, float, str] | None = None
        rows = [(self.starts[""], list(range(len(start) + 1)))]
        while rows:
            node, row = rows.pop()
            for c, child in node.items():
                if not c:
                    if (d := min(row)) <= edits(len(child) - FREE):
                        found = d, -self.stems[child], child
                        best = found if best is None else min(best, found)
                elif len(c) == 1:
                    new = _next(row, start, c)
                    if min(new) <= child["most"]:
                        rows.append((child, new))
        return (best[0], best[2]) if best else None


def _next(row: list[int], word: str, c: str) -> list[int]:
    """The row of distances after one more character of the path."""
    left = row[0] + 1
    new = [left]
    for i, w in enumerate(word):
        x = row[i] if w == c else row[i] + 1
        if left + 1 < x:
            x = left + 1
        if row[i + 1] + 1 < x:
            x = row[i + 1] + 1
        new.append(x)
        left = x
    return new


def edits(length: int) -> int:
    """Edits allowed for an entry of so many characters."""
    return 2 if length >= TWO_EDITS else 1 if length >= ONE_EDIT else 0


class Model(NamedTuple):
    weights: dict[str, float]
    stems: dict[str, float]
    harmless: frozenset[str]
    fit: Logistic | None


class Matcher:
    """Weights of words, and the evidence of texts."""

    def __init__(self, model: Model) -> None:
        self.trie = Trie(model.weights, model.stems)
        self.harmless = model.harmless
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """0 for a word that matches nothing."""
        if (w := self.known.get(word)) is None:
            w = self._weight(word)
            if len(word) <= KEPT_WORD:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[word] = w
        return w

    def _weight(self, word: str) -> float:
        t = self.trie
        if word in t.weights:
            return t.weights[word]
        if word in self.harmless:
            return 0.0
        entry, stem = t.nearest(word), t.beginning(word)
        return max(MISSPELT ** entry[0] * t.weights[entry[1]] if entry else 0.0, MISSPELT ** stem[0] * t.stems[stem[1]] if stem else 0.0)

    def evidence(self, text: str) -> tuple[float, float, float]:
        """Weighted hits in context, their share among the words, and the heaviest hit."""
        low = text.lower()
        found = WORD.findall(low)
        hits = {w for w in set(found) if self.weight(w)}
        if not hits:
            return 0.0, 0.0, 0.0
        total = top = 0.0
        for m in WORD.finditer(low):
            if m.group() in hits:
                w = self.weight(m.group()) * self.context(low, m.start(), m.end())
                total += w
                top = max(top, w)
        return math.log1p(total), math.log1p(1000 * total / (len(found) + 50)), top

    @staticmethod
    def context(low: str, start: int, end: int) -> float:
        """What the window around a hit does to its weight."""
        before, after = low[max(0, start - WINDOW) : start].rpartition("\n")[2], low[end : end + WINDOW].partition("\n")[0]
        factor = 1.0
        if any(before.count(o) % 2 if o == c else before.rfind(o) > before.rfind(c) for o, c in zip(_OPEN, _CLOSE, strict=True)) and any(c in after for c in _CLOSE):
            factor *= QUOTED
        if _REPORT.search(before):
            factor *= REPORTED
        if _ADDRESS.search(before) or _ADDRESS.search(after):
            factor *= ADDRESSED
        return factor


def _words_of(sample: DataFrame) -> DataFrame:
    """(word, label) for each distinct word of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                own, of = [], []
                for text, label in zip(b.column("text")[i : i + 256].to_pylist(), b.column("label")[i : i + 256].to_pylist(), strict=True):
                    found = set(WORD.findall(text.lower()))
                    own += found
                    of += [label] * len(found)
                yield pa.record_batch({"word": pa.array(own, pa.string()), "label": pa.array(of, pa.int32())})

    return sample.select("text", "label").mapInArrow(run, "word string, label int")


def _surprising(counts: DataFrame, n1: int, n0: int, least: float) -> DataFrame:
    """Of (word, a, b), texts of either class with the word, those far more frequent among toxic texts; weight and gain.

    A word enters if it is twenty times as frequent in toxic texts as elsewhere
    and if the log-likelihood gain of its own rate over the common one is above
    ``least``; a word with a prior needs a gain of 2.
    """
    expected = (F.col("a") + F.col("b")) * F.lit(n1 / max(1, n1 + n0))
    gain = F.col("a") * F.log(F.col("a") / expected) - (F.col("a") - expected)
    rate = ((F.col("a") + 0.5) / F.lit(n1 + 1.0)) / ((F.col("b") + 0.5) / F.lit(n0 + 1.0))
    found = counts.where("a > 0").withColumn("gain", gain).withColumn("rate", rate).where("rate > 20")
    found = found.where((F.col("gain") > least) | (F.col("word").isin(*PLAIN) & (F.col("gain") > 2)))
    return found.select("word", F.log("rate").alias("weight"), "gain")


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Model:
    """Lexicon, harmless words and calibration from at most ``SAMPLE_ROWS`` labelled rows of each class outside the held-out fold."""
    sample, sizes = labelled_sample(docs, labels, "toxic", folds, held_out, SAMPLE_ROWS, SAMPLE_TEXT)
    sample = stored(sample.dropDuplicates(["text", "label"]), "toxic-sample")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(dict.fromkeys(PLAIN, 4.0), {}, frozenset(), None)
    counts = _words_of(sample).groupBy("word").agg(F.sum("label").cast("long").alias("a"), F.sum(1 - F.col("label")).cast("long").alias("b"))
    counts = stored(counts, "toxic-words")
    # by chance none of the words that were tried would gain so much, at odds of a thousand
    least = math.log(max(1, counts.where("a > 2").count())) + math.log(1000)
    weights = {r["word"]: r["weight"] for r in _surprising(counts, n1, n0, least).collect()}
    starts = counts.where(F.length("word") > STEM[0]).withColumn("k", F.explode(F.array(*map(F.lit, range(STEM[0], STEM[1] + 1))))).where("length(word) > k")
    starts = starts.groupBy(F.expr("substring(word, 1, k)").alias("word")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("forms"))
    stems: dict[str, float] = {}
    # a text may hold several forms: three times the gain is asked for, and three forms
    for r in sorted(_surprising(starts.where("forms > 2"), n1, n0, 3 * least).collect(), key=lambda r: (len(r["word"]), r["word"])):
        if not any(r["word"].startswith(s) for s in stems):
            stems[r["word"]] = r["weight"]
    weights = weights or ({} if stems else dict.fromkeys(PLAIN, 4.0))
    # words of clean texts that only look like entries
    bare = Model(weights, stems, frozenset(), None)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(bare)
        for b in batches:
            yield b.filter(pa.array([w not in m.trie.weights and m.weight(w) > 0 for w in b.column("word").to_pylist()], pa.bool_()))

    clean = counts.where("b > 0").select("word").mapInArrow(alike, "word string")
    harmless = frozenset(r["word"] for r in clean.collect())
    model = Model(weights, stems, harmless, None)
    rows = sample.where("label = 1").orderBy(F.xxhash64("doc_id"), "text").limit(CALIBRATION_ROWS).unionByName(sample.where("label = 0").orderBy(F.xxhash64("doc_id"), "text").limit(CALIBRATION_ROWS))
    seen = _evidence(rows.select("text", "label"), model).collect()
    x = np.array([[r["e1"], r["e2"], r["e3"]] for r in seen])
    y = np.array([float(r["label"]) for r in seen])
    prior = (sizes.get(1, 0) + 1) / (sizes.get(1, 0) + sizes.get(0, 0) + 2)
    share = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    return model._replace(fit=Logistic(x, y, share, ridge=0.1))


_matchers: list[tuple[Model, Matcher]] = []


def matcher(model: Model) -> Matcher:
    """The worker's matcher for a model, with the words that it has met in earlier tasks."""
    if not _matchers or _matchers[0][0][:3] != model[:3]:
        _matchers[:] = [(model, Matcher(model))]
    return _matchers[0][1]


def _evidence(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(model)
        for b in batches:
            e = [m.evidence(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"label": b.column("label"), **{f"e{k + 1}": pa.array([x[k] for x in e], pa.float64()) for k in range(3)}})

    return rows.mapInArrow(run, "label int, e1 double, e2 double, e3 double")


def _scores(m: Matcher, model: Model, texts: list[str | None]) -> np.ndarray:
    x = np.array([m.evidence(t or "") for t in texts], dtype=float).reshape(-1, 3)
    return model.fit(x) if model.fit is not None else 1 - np.exp(-np.maximum(0, np.expm1(x[:, 0])) / 4)


def score_toxicity(docs: DataFrame, model: Model, folds: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 if score >= threshold).

    Null text counts as empty; an empty text has the score of no hits. Null
    doc_id: scored, not held out. Repeated rows: each is scored. Without labels
    of both kinds the plain lexicon and an uncalibrated score serve. An empty
    table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(shared.value)
        for b in batches:
            p = _scores(m, shared.value, b.column("text").to_pylist())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))})

    rows = documents(docs).select("doc_id", "text", (fold(folds) == held_out).alias("held_out"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(shared.value)
        for b in batches:
            yield b.filter(pa.array(_scores(m, shared.value, b.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
