"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as
a-z. Every word gets a 64-bit polynomial hash from prefix sums (arithmetic
modulo 2**64), so no Python object is made for a word. Texts are taken in
slices of at most ``SLICE`` bytes at document borders; only a single document
that is longer makes a longer slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte; upper case has that of lower case."""
    values = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))
    values[65:91] = values[97:123]
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUES = _byte_values()
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE)
        have = np.full(size, base, dtype=_U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


class Words(NamedTuple):
    """Words of the documents first..first+len(bounds)-2 of a batch; document i has words bounds[i]:bounds[i+1]."""

    first: int
    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray  # byte where each word begins, in data
    ends: np.ndarray
    data: np.ndarray


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
        if not pa.types.is_string(column.type):
            column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return at - at[0], raw


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of documents (from, to) of at most ``most`` bytes together, or one document alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(column: pa.Array, breaks: np.ndarray = SPACE, values: np.ndarray = _VALUES) -> Iterator[Words]:
    """Hashes of all words of a string column, slice by slice; ``breaks`` marks the bytes between words."""
    offsets, raw = string_parts(column)
    for i, j in slices(offsets):
        at = offsets[i : j + 1] - offsets[i]
        data = raw[offsets[i] : offsets[j]]
        n = len(data)
        if n == 0:
            none = np.zeros(0, dtype=np.int64)
            yield Words(i, none.astype(_U), np.zeros(j - i + 1, dtype=np.int64), none, none, data)
            continue
        inside = ~breaks[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        total = np.empty(n + 1, dtype=_U)
        total[0] = 0
        np.cumsum(values[data] * _power(_BASE, n), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * _power(_BASE_INVERSE, n)[starts])
        yield Words(i, hashes, np.searchsorted(starts, at), starts, ends, data)


_POSITION = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for aligned word hashes; their order counts."""
    out = parts[0] * _POSITION[0]
    for k, x in enumerate(parts[1:], 1):
        out = out + x * _POSITION[k]
    return mix(out)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each word but the last n-1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    return combined([hashes[k : k + m] for k in range(n)])


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of one document; with fewer words, the whole sequence is one shingle."""
    if len(hashes) >= n:
        return np.unique(ngrams(hashes, n))
    if len(hashes) == 0:
        return np.zeros(0, dtype=_U)
    return mix(combined([hashes[k : k + 1] for k in range(len(hashes))]) + _U(len(hashes)))
