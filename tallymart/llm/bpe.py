"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are parted into pieces by arrays over code points, so that no object is
made for a piece. The pieces of a slice that haven't been met before are laid
out in one sequence of symbols. An index maps each pair of neighbouring symbols
to all its positions there. The ranks of the pairs that occur wait in a heap:
the lowest is applied at all its positions at once, and only the lists of the
pairs to the left and right of each merge are updated. Pieces met again come
from a bounded table, so the work follows the number of distinct pieces. What
is decoded is compared with the text byte for byte.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallymart.llm import tokens as T
from tallymart.llm.common import documents, lean, tokenizer_path

#: Pieces kept by a worker before it starts anew; bytes of one longer than this aren't kept.
KEPT, KEPT_PIECE = 400_000, 64
#: Characters taken at a time: short texts together, a longer one in blocks that end between pieces.
STEP = 1 << 21
#: Pieces hashed at a time.
HASHED = 1 << 18


def _byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def newer_characters() -> str:
    """Letters and numbers of a later Unicode version than that of the tokenizers library, for which they are other characters.

    The result is the inside of a character class, as ranges. Only characters
    that Python's own tables don't know are asked for.
    """
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    word = regex.compile(r"[\p{L}\p{N}]")
    unknown = (c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and word.match(c))
    ranges: list[list[int]] = []
    for c in (ord(c) for c in unknown if len(split("a" + c)) > 1 and len(split("1" + c)) > 1):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


OTHER, LETTER, NUMBER, SPACE = range(4)


@cache
def character_classes() -> np.ndarray:
    """The class of each code point: letters, numbers, white space, and all others."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    out = np.zeros(len(every), dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    if newer := newer_characters():
        for m in regex.finditer(f"[{newer}]+", every):
            out[m.start() : m.end()] = OTHER
    return out


def piece_starts(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, from the code points of all and a mark at the first of each text.

    The parts are those of the pattern of byte-level vocabularies: a
    contraction; a run of letters, of numbers or of others, with one blank
    before it; white space up to the last before such a run, else all of it.
    """
    n = len(points)
    kind = character_classes()[points]
    start = edge.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:] & ~edge[1:] & (kind[:-1] == SPACE) & (kind[1:] != SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    at = np.flatnonzero((points == 39) & start)
    for letters in ("s", "t", "re", "ve", "m", "ll", "d"):
        k = len(letters)
        hit = at[at + k < n]
        for j, c in enumerate(letters, 1):
            hit = hit[(points[hit + j] == ord(c)) & ~edge[hit + j]]
        start[hit + 1] = False
        rest = hit + k + 1
        start[rest[rest < n]] = True
    return np.flatnonzero(start)


@cache
def _weights(n: int) -> np.ndarray:
    """Odd factors of positions in a piece, for at least ``n`` of them."""
    return T.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


@cache
def _values() -> np.ndarray:
    """A fixed 64-bit value of each code point."""
    return T.mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... anew for each of the sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def piece_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece."""
    sizes = np.diff(starts, append=len(points))
    weights = _weights(1 << max(8, int(sizes.max()).bit_length()))
    out = np.empty(len(starts), dtype=np.uint64)
    for i in range(0, len(starts), HASHED):
        own, first = sizes[i : i + HASHED], starts[i]
        values = _values()[points[first : first + int(own.sum())]] * weights[_within(own)]
        out[i : i + HASHED] = np.add.reduceat(values, starts[i : i + HASHED] - first)
    return T.mix(out + sizes.astype(np.uint64))


class Encoded(NamedTuple):
    """Pieces in order: where each begins in the text, its tokens, their decimal ids each with a comma behind, and what they decode to."""

    starts: np.ndarray
    tokens: np.ndarray
    ids: pa.BinaryArray
    decoded: pa.BinaryArray


class PairIndexCodec:
    """Encoder and decoder of a byte-level BPE vocabulary file (tokenizers' JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = _byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        vocabulary = {raw(k): v for k, v in spec["model"]["vocab"].items() if all(c in symbols for c in k)}
        self.bytes_of = {v: k for k, v in vocabulary.items()}
        self.first = np.array([vocabulary[bytes([b])] for b in range(256)], dtype=np.int64)
        ranks: dict[int, int] = {}  # left symbol << 32 | right symbol: rank
        self.rules: list[tuple[int, int, int]] = []  # by rank: left, right, what they become
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.rules.append((vocabulary[left], vocabulary[right], vocabulary[left + right]))
            ranks[vocabulary[left] << 32 | vocabulary[right]] = rank
        by_pair = sorted(ranks.items())
        self.pairs = np.array([p for p, _ in by_pair] + [np.iinfo(np.int64).max])  # ascending
        self.rank_of_pair = np.array([r for _, r in by_pair] + [-1])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        every = range(max(self.bytes_of) + 1)
        self.decimals = pa.array([b"%d," % i for i in every], pa.binary())
        self.token_bytes = pa.array([self.bytes_of.get(i, b"") for i in every], pa.binary())
        self.forget()

    def forget(self) -> None:
        """Empty the table of pieces."""
        self.keys = np.zeros(0, dtype=np.uint64)  # ascending hashes
        self.tokens = np.zeros(0, dtype=np.int64)
        self.ids, self.decoded = pa.array([], pa.binary()), pa.array([], pa.binary())

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; -1 where they never merge."""
        pairs = left << 32 | right
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.rank_of_pair[at], -1)

    def merge_all(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and where those of each begin, by one pair occurrence index over all of them.

        ``raw``: the bytes of the pieces; piece i has those from bounds[i] to bounds[i + 1].
        """
        n = len(raw)
        ids = np.append(self.first[raw], -1)  # position n stands for none
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[bounds[1:] - 1], before[bounds[:-1]] = n, n
        index: dict[int, list[np.ndarray]] = {}  # rank of a pair: its positions

        def put(ranks: np.ndarray, where: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, where = ranks[order], where[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, own in zip(ranks[np.append(0, cuts)].tolist(), np.split(where, cuts) if len(cuts) else [where], strict=True):
                if rank in index:
                    index[rank].append(own)
                else:
                    index[rank] = [own]
                    heapq.heappush(active, rank)

        active: list[int] = []
        pairs = np.flatnonzero(after[:n] < n)
        ranks = self._ranks_of(ids[pairs], ids[pairs + 1])
        if (ranks >= 0).any():
            put(ranks[ranks >= 0], pairs[ranks >= 0])
        while active:
            rank = heapq.heappop(active)
            left, right, made = self.rules[rank]
            lists = index.pop(rank)
            where = lists[0] if len(lists) == 1 else np.concatenate(lists)
            next_ = after[where]
            fits = (ids[where] == left) & (ids[next_] == right)
            where, next_ = where[fits], next_[fits]
            if left == right and len(where):
                where = self._apart(where, after)
                next_ = after[where]
            if not len(where):
                continue
            ids[where], ids[next_] = made, -1
            behind = after[next_]
            after[where], before[behind] = behind, where
            ahead = before[where]
            near = np.concatenate([where[behind < n], ahead[ahead < n]])
            if len(near):
                ranks = self._ranks_of(ids[near], ids[after[near]])
                if (ok := ranks >= 0).any():
                    put(ranks[ok], near[ok])
        alive = ids[:n] >= 0
        return ids[:n][alive], np.concatenate([[0], np.cumsum(alive)])[bounds]

    @staticmethod
    def _apart(where: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of the positions of a pair of equal symbols those that merge: overlapping ones from the left."""
        out, taken = [], -1
        for i in np.unique(where).tolist():
            if i != taken:
                out.append(i)
                taken = int(after[i])
        return np.array(out, dtype=np.int64)

    def learn(self, hashes: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> None:
        """Encode new pieces and put them into the table."""
        made, at = self.merge_all(raw, bounds)
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.tokens = np.concatenate([self.tokens, np.diff(at)])[order]
        rows = pa.array(made)
        self.ids, self.decoded = (pa.concat_arrays([old, _joined(of.take(rows), at)]).take(pa.array(order)) for old, of in ((self.ids, self.decimals), (self.decoded, self.token_bytes)))

    def _shortened(self, most: int) -> None:
        """Drop long pieces, and all if more than ``most`` are left."""
        sizes = np.diff(np.frombuffer(self.decoded.buffers()[1], dtype=np.int32)[self.decoded.offset : self.decoded.offset + len(self.decoded) + 1]) if len(self.decoded) else np.zeros(0)
        if len(sizes) > most:
            self.forget()
        elif (long := sizes > KEPT_PIECE).any():
            keep = pa.array(np.flatnonzero(~long))
            self.keys, self.tokens = self.keys[~long], self.tokens[~long]
            self.ids, self.decoded = self.ids.take(keep), self.decoded.take(keep)

    def encoded(self, points: np.ndarray, edge: np.ndarray, starts: np.ndarray | None = None) -> Encoded:
        """The pieces of texts, given as code points with a mark at the first of each text."""
        starts = piece_starts(points, edge) if starts is None else starts
        distinct, where, which = np.unique(piece_hashes(points, starts), return_index=True, return_inverse=True)
        self._shortened(KEPT)
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        if new.any():
            first = starts[where[new]]
            sizes = np.append(starts[1:], len(points))[where[new]] - first
            found = points[np.repeat(first, sizes) + _within(sizes)]
            # a character has as many bytes as steps of its code point
            bytes_ = 1 + (found > 0x7F).astype(np.int64) + (found > 0x7FF) + (found > 0xFFFF)
            at = np.concatenate([[0], np.cumsum(bytes_)])
            bounds = at[np.concatenate([[0], np.cumsum(sizes)])]
            self.learn(distinct[new], np.frombuffer(found.tobytes().decode("utf-32-le").encode(), dtype=np.uint8), bounds)
            at = np.searchsorted(self.keys, distinct)
        at = at[which]
        rows = pa.array(at)
        return Encoded(starts, self.tokens[at], self.ids.take(rows), self.decoded.take(rows))

    def blocks(self, text: str) -> Iterator[Encoded]:
        """The pieces of one text without added tokens, in blocks of about STEP characters."""
        at, size = 0, STEP
        while at < len(text):
            part = text[at : at + size]
            points = np.frombuffer(part.encode("utf-32-le"), dtype="<u4")
            edge = np.zeros(len(points), dtype=bool)
            edge[0] = True
            starts = piece_starts(points, edge)
            end = len(points)
            if at + size < len(text):
                # what ends at a later start may depend on what follows the block
                sure = starts[starts <= end - 4]
                end = int(sure[-1])
                if not end:
                    size *= 2
                    continue
                starts = starts[starts < end]
            yield self.encoded(points[:end], edge[:end], starts)
            at, size = at + end, STEP

    def parts(self, text: str) -> Iterator[Encoded | int]:
        """The blocks of a text, and the ids of added tokens between them."""
        at = 0
        for m in self.added_pattern.finditer(text) if self.added_pattern else ():
            yield from self.blocks(text[at : m.start()])
            yield self.added[m.group()]
            at = m.end()
        yield from self.blocks(text[at:] if at else text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for x in self.parts(text):
            out += [x] if isinstance(x, int) else map(int, _bytes(x.ids)[:-1].tobytes().split(b","))
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _offsets(a: pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(a.buffers()[1], dtype=np.int32)[a.offset : a.offset + len(a) + 1]


def _joined(values: pa.BinaryArray, at: np.ndarray) -> pa.BinaryArray:
    """Values at[i] to at[i + 1] as one, for each i."""
    offsets = _offsets(values)[at]
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), values.buffers()[2]])


def _bytes(a: pa.BinaryArray) -> np.ndarray:
    """The bytes of all values of a binary array, one after another."""
    at = _offsets(a)
    return np.frombuffer(a.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if len(a) and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)


_codecs: dict[str, PairIndexCodec] = {}


def codec(name: str, folder: str | None) -> PairIndexCodec:
    """The worker's codec for a vocabulary, read once."""
    path = tokenizer_path(name, folder)
    if path not in _codecs:
        _codecs[path] = PairIndexCodec(path)
    return _codecs[path]


Digest = tuple[int, str, str]


def _digest(c: PairIndexCodec, text: str) -> Digest:
    """Number of ids, digest of the ids, digest of the decoded text, of a text taken in blocks."""
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
    for x in c.parts(text):
        if isinstance(x, int):
            ids, tokens, decoded = b"%d," % x, 1, c.bytes_of[x]
        else:
            ids, tokens, decoded = memoryview(_bytes(x.ids)), int(x.tokens.sum()), memoryview(_bytes(x.decoded))
        of_ids.update(b"," if n else b"")
        of_ids.update(ids[:-1])
        of_text.update(decoded)
        n += tokens
    return n, of_ids.hexdigest(), of_text.hexdigest()


def _digests(c: PairIndexCodec, texts: list[str]) -> list[Digest]:
    """As :func:`_digest` for texts without added tokens, together shorter than a few STEPs."""
    sizes = np.array([len(t) for t in texts])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if not bounds[-1]:
        return [_digest(c, t) for t in texts]
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
    edge = np.zeros(len(points), dtype=bool)
    edge[bounds[:-1][sizes > 0]] = True
    x = c.encoded(points, edge)
    if _bytes(x.decoded).tobytes() != whole.encode():  # a collision of hashes
        c.forget()
        return [_digest(c, t) for t in texts]
    first = np.searchsorted(x.starts, bounds)
    n = np.concatenate([[0], np.cumsum(x.tokens)])[first]
    ids, decoded = memoryview(_bytes(x.ids)), memoryview(_bytes(x.decoded))
    of_ids, of_text = _offsets(x.ids)[first], _offsets(x.decoded)[first]
    out = []
    for k in range(len(texts)):
        out.append((int(n[k + 1] - n[k]), hashlib.sha256(ids[of_ids[k] : max(of_ids[k], of_ids[k + 1] - 1)]).hexdigest(), hashlib.sha256(decoded[of_text[k] : of_text[k + 1]]).hexdigest()))
    return out


def _groups(texts: list[str], alone: regex.Pattern | None) -> Iterator[list[str]]:
    """Texts in order: those longer than STEP or with an added token by themselves, others together."""
    group: list[str] = []
    total = 0
    for t in texts:
        if len(t) > STEP or (alone and alone.search(t)):
            yield group
            yield [t]
            group, total = [], 0
            continue
        group.append(t)
        total += len(t)
        if total >= STEP:
            yield group
            group, total = [], 0
    yield group


def round_trip(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 of the whole text, encoded and decoded again.

    Null text counts as empty: no ids, digests of nothing. Null doc_id and
    repeated rows: each row has its result. An empty table gives an empty table;
    other columns aren't read. ``folder``: where the vocabulary file lies on
    every executor, if not in the ``public_tokenizers`` package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, folder)
        for b in batches:
            out = []
            for group in _groups(b.column("text").to_pylist(), c.added_pattern):
                out += _digests(c, group) if len(group) > 1 else [_digest(c, t) for t in group]
            n, ids, text = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(text, pa.string())})

    return documents(docs).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """Per row: doc_id and ids, the token ids of the whole text. Nulls and empty tables as in :func:`round_trip`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, folder)
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.array([c.encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))})

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, name: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """Per row: doc_id and text, from doc_id and ids. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name, folder)
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array([c.decode(x or ()) for x in b.column("ids").to_pylist()], pa.string())})

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
