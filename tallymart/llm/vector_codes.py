"""Vector compression by product codes whose codebooks are learned by Yinyang k-means.

Vectors become integers and are cut into parts; each part position has a
codebook. An assignment keeps, per part, an upper bound of the distance to its
entry and one lower bound for each group of entries. When entries move, the
bounds move by their drift, and only groups whose bound no longer excludes them
are scanned (Ding et al., "Yinyang K-Means", 2015). Bounds are rounded outwards
and a group is passed over only if it lies strictly farther; whatever is scanned
is compared by whole squared distances, so ties go to the lower index as in a
full scan. Between rounds vectors and bounds are a table in the shared folder,
and of a round the driver sees the sums of each entry only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.llm.common import dropped, lean, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries of a group on average, and steps of the clustering of entries.
GROUP, GROUPING = 10, 5
#: Integers are held within this bound, so that sums of squares stay in 64 bits.
LARGEST = 1 << 28
#: Vectors handled at once.
BLOCK = 4096


class Codebooks(NamedTuple):
    """Entries (part, entry, component), the group of each entry, and how far each has moved since the last assignment."""

    entries: np.ndarray
    group: np.ndarray
    drift: np.ndarray


def groups_of(entries: np.ndarray) -> np.ndarray:
    """A group for every entry of one part: plain k-means over the entries, from evenly spaced ones."""
    n = len(entries)
    k = max(1, n // GROUP)
    centres = entries[np.arange(k) * n // k].astype(float)
    for _ in range(GROUPING):
        own = ((entries[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(k):
            if (own == g).any():
                centres[g] = entries[own == g].mean(axis=0)
    return own


def _squares(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Whole squared distances of each row to each entry."""
    out = np.zeros((len(v), len(entries)), dtype=np.int64)
    for j in range(v.shape[1]):
        d = v[:, j, None] - entries[None, :, j]
        out += d * d
    return out


def _upper(x: np.ndarray) -> np.ndarray:
    """At least ``x``, as half floats."""
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float16), np.float16(np.inf))


def _lower(x: np.ndarray) -> np.ndarray:
    """At most ``x`` and at least 0, as half floats."""
    return np.maximum(np.nextafter(np.minimum(x, 60000).astype(np.float16), np.float16(-np.inf)), np.float16(0))


def first_assignment(v: np.ndarray, entries: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row by a full scan: index, squared distance, upper bound, lower bound per group."""
    d = _squares(v, entries)
    best = d.argmin(axis=1)
    error = d[np.arange(len(v)), best]
    rest = d.astype(float)
    rest[np.arange(len(v)), best] = np.inf
    low = np.stack([rest[:, group == g].min(axis=1) if (group == g).any() else np.full(len(v), np.inf) for g in range(int(group.max()) + 1)], axis=1)
    return best, error, _upper(np.sqrt(error)), _lower(np.sqrt(low))


def next_assignment(v: np.ndarray, entries: np.ndarray, group: np.ndarray, drift: np.ndarray, best: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries have moved by ``drift``, from the bounds of before; and how many row-to-entry distances were computed."""
    k = lower.shape[1]
    moved = np.array([drift[group == g].max(initial=0.0) for g in range(k)])
    # a float64 sum of a rounded bound and a root is off by far less than this
    low = lower.astype(float) - moved * (1 + 1e-9) - 1e-9
    high = upper.astype(float) + drift[best] * (1 + 1e-9) + 1e-9
    old = best.copy()
    best = best.copy()
    error = ((v - entries[best]) ** 2).sum(axis=1)  # exact, and needed as the final error anyway
    scanned = len(v)
    open_ = np.flatnonzero((low <= high[:, None]).any(axis=1))
    exact = np.sqrt(error[open_]) * (1 + 1e-9)
    fails = low[open_] <= np.minimum(high[open_], exact)[:, None]
    least, second = np.full((len(v), k), np.inf), np.full((len(v), k), np.inf)
    arg = np.full((len(v), k), -1)
    for g in range(k):
        rows = open_[fails[:, g]]
        members = np.flatnonzero(group == g)
        if not len(rows) or not len(members):
            continue
        d = _squares(v[rows], entries[members])
        scanned += d.size
        at = d.argmin(axis=1)
        found = d[np.arange(len(rows)), at]
        least[rows, g], arg[rows, g] = found, members[at]
        d = d.astype(float)
        d[np.arange(len(rows)), at] = np.inf
        second[rows, g] = d.min(axis=1)
        wins = (found < error[rows]) | ((found == error[rows]) & (members[at] < best[rows]))
        error[rows[wins]], best[rows[wins]] = found[wins], members[at[wins]]
    seen = arg >= 0
    low = np.where(seen, np.sqrt(np.where(arg == best[:, None], second, least)), np.maximum(low, 0))
    # a group that wasn't scanned takes back the entry that has lost its row
    lost = np.flatnonzero(old != best)
    back = group[old[lost]]
    unseen = ~seen[lost, back]
    rows, back = lost[unseen], back[unseen]
    low[rows, back] = np.minimum(low[rows, back], np.sqrt(((v[rows] - entries[old[rows]]) ** 2).sum(axis=1)))
    return best, error, _upper(np.sqrt(error)), _lower(low), scanned


def kept_vectors(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and ``v`` (256 times each component, floored) of the rows whose vector has no null, NaN or infinite component."""
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    whole = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * 256))).cast("int")
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("x"))
    return rows.where(F.col("x").isNotNull() & ~F.exists("x", wrong)).select("vec_id", "label", F.transform("x", whole).alias("v"))


def _assign(rows: DataFrame, books: Codebooks, first: bool, last: bool) -> DataFrame:
    """Rows (vec_id, label, v, and from the second time on ``state``) with their new state, or at last with code and error."""
    parts, n, width = books.entries.shape
    sizes = [int(g.max()) + 1 for g in books.group]
    ends = np.concatenate([[0], np.cumsum([1 + 2 + 2 * k for k in sizes])])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                m = b.num_rows
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(m, parts, width).astype(np.int64)
                state = None if first else np.frombuffer(b"".join(b.column("state").to_pylist()), dtype=np.uint8).reshape(m, -1)
                code, new, error = np.empty((m, parts), np.uint8), [], np.zeros(m, np.int64)
                for p in range(parts):
                    if first:
                        best, e, up, low = first_assignment(v[:, p], books.entries[p], books.group[p])
                    else:
                        own = np.ascontiguousarray(state[:, ends[p] : ends[p + 1]])
                        bounds = np.ascontiguousarray(own[:, 1:]).view(np.float16)
                        best, e, up, low, _ = next_assignment(v[:, p], books.entries[p], books.group[p], books.drift[p], own[:, 0].astype(int), bounds[:, 0], bounds[:, 1:])
                    code[:, p] = best
                    error += e
                    if not last:
                        new += [code[:, p : p + 1], np.column_stack([up, low]).view(np.uint8)]
                out = {"vec_id": b.column("vec_id"), "label": b.column("label")}
                if last:
                    out |= {"code": pa.array([bytes(c).hex() for c in code], pa.string()), "error": pa.array(error)}
                else:
                    flat = np.concatenate(new, axis=1)
                    out |= {"v": b.column("v"), "state": pa.array([bytes(x) for x in flat], pa.binary())}
                yield pa.RecordBatch.from_pydict(out)

    kept = {f.name: f.dataType.simpleString() for f in rows.schema}
    more = "code string, error long" if last else "v array<int>, state binary"
    return rows.mapInArrow(run, f"vec_id long, label {kept['label']}, {more}")


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Entries replaced by the floored means of their parts; those without parts stay."""
    parts, n, width = books.entries.shape
    ends = np.concatenate([[0], np.cumsum([1 + 2 + 2 * (int(g.max()) + 1) for g in books.group])])[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, parts, width).astype(np.int64)
            state = np.frombuffer(b"".join(b.column("state").to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            for p in range(parts):
                best = state[:, ends[p]]
                np.add.at(total[p], best, v[:, p])
                count[p] += np.bincount(best, minlength=n)
        p, e, j = np.nonzero(np.broadcast_to(count[:, :, None] > 0, total.shape))
        yield pa.RecordBatch.from_pydict({"p": pa.array(p, pa.int32()), "e": pa.array(e, pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(count[p, e]), "s": pa.array(total[p, e, j])})

    sums = rows.select("v", "state").mapInArrow(run, "p int, e int, j int, n long, s long").groupBy("p", "e", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = books.entries.copy()
    for r in sums.collect():  # one row for each component of each entry
        new[r["p"], r["e"], r["j"]] = r["s"] // r["n"]
    drift = np.sqrt(((new - books.entries) ** 2).sum(axis=2))
    return Codebooks(new, books.group, drift)


def _digest(books: Codebooks | None) -> str:
    values = [] if books is None else books.entries.reshape(-1).tolist()
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


def learned(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of rows from :func:`kept_vectors`, and the final codebooks.

    A codebook starts as its part of the ``entries`` (256 at most) smallest
    vec_ids, ascending; nulls come last and rows of one vec_id by their vector.
    All vectors have the length of the first of them, which ``parts`` divides.
    """
    rows = stored(rows, "vectors")
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    usable = [r["v"] for r in seeds if len(r["v"]) == len(seeds[0]["v"]) and r["v"]]
    if len(usable) < len(seeds) or (seeds and len(usable[0]) % parts):
        raise ValueError(f"vectors must have one length that {parts} divides")
    if not usable:
        kind = rows.schema["label"].dataType.simpleString()
        return rows.select("vec_id", F.col("label").cast(kind).alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    start = np.array(usable, dtype=np.int64).reshape(len(usable), parts, -1).transpose(1, 0, 2).copy()
    books = Codebooks(start, np.stack([groups_of(x) for x in start]), np.zeros(start.shape[:2]))
    for k in range(rounds):
        now = stored(_assign(rows, books, k == 0, False), f"vectors-{k}")
        books = _moved(now, books)
        dropped(rows)
        rows = now
    out = stored(_assign(rows, books, rounds == 0, True), "vector-codes")
    dropped(rows)
    return out, books


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: vec_id, code (two hex digits a part), error (squared distance), label_error (of all with its label), codebooks_sha256.

    Rows whose vector is null or holds a null, NaN or infinite component are
    left out, and so are empty ones, those whose length ``parts`` doesn't
    divide, and then those of another length than the one with the least
    vec_id. Components beyond 2**20 count as that. Null labels
    count as one label, null vec_ids come last. Repeated rows: each is coded,
    and each may be an entry. Ties go to the lower index. Fewer vectors than
    entries: as many entries as vectors. An empty table gives an empty table;
    other columns aren't read.
    """
    rows = kept_vectors(vectors).where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    if first:
        rows = rows.where(F.size("v") == first[0])
    out, books = learned(rows, parts, entries, rounds)
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    same: Column = out["label"].eqNullSafe(sums["of"])
    return out.join(sums, same).select("vec_id", "code", "error", "label_error", F.lit(_digest(books)).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id and ``v``, the integers that a code stands for."""
    width = books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.frombuffer(bytes.fromhex("".join(b.column("code").to_pylist())), dtype=np.uint8).reshape(b.num_rows, -1)
            v = books.entries[np.arange(at.shape[1]), at].reshape(b.num_rows, at.shape[1] * width)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "v": pa.array(v.tolist(), pa.list_(pa.int64()))})

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, v array<long>")


def _assigned(name: str, books: str) -> str:
    """SQL: the nearest entry of each part."""
    return f"""
{name} AS (SELECT r, p, any_value(x) AS x, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
  SELECT r, q.p, q.x, e, list_sum(list_transform(list_zip(q.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM q JOIN {books} c ON q.p = c.p) GROUP BY r, p)"""


def _replaced(name: str, assigned: str, books: str) -> str:
    """SQL: the floored means of each entry's parts."""
    return f"""
{name} AS (SELECT c.p, c.e, coalesce(m.y, c.y) AS y FROM {books} c LEFT JOIN (
  SELECT p, e, list(floor(s / n)::BIGINT ORDER BY j) AS y FROM (
    SELECT p, e, j, sum(x[j])::DOUBLE AS s, count(*) AS n FROM {assigned}, (SELECT unnest(generate_series(1, {{width}})) AS j) GROUP BY p, e, j) GROUP BY p, e) m USING (p, e))"""


#: DuckDB SQL for :func:`coded` over vectors of 64 components.
ORACLE = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, p, v[p * 4 + 1 : p * 4 + 4] AS x FROM k, (SELECT unnest(range(0, 16)) AS p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM q WHERE r <= 64),
{_assigned("a1", "c0").replace(" AS (", " AS MATERIALIZED (", 1)},
{_replaced("c1", "a1", "c0").replace(" AS (", " AS MATERIALIZED (", 1)},
{_assigned("a2", "c1").replace(" AS (", " AS MATERIALIZED (", 1)},
{_replaced("c2", "a2", "c1").replace(" AS (", " AS MATERIALIZED (", 1)},
{_assigned("a3", "c2").replace(" AS (", " AS MATERIALIZED (", 1)},
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM k JOIN o USING (r)
""".replace("{width}", "4")
