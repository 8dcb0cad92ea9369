"""Exact n-gram Jaccard join by vertical partitioning.

The distinct n-word shingles of a document are put in one global order:
shingles that are frequent in a sketch of the whole corpus come last, others
follow their hash. The join then works in these steps, all exact:

1. Documents with equal shingle sets form a class; one stands for it.
2. Two sets whose Jaccard similarity reaches the threshold share a shingle
   among the first ``n - ceil(t n) + 1`` of each. Documents that share one meet
   in a group, once for all shingles that the same documents share; groups above
   ``GROUP`` documents are dealt as pairs of blocks.
3. In a group, parity bitmaps bound the difference of two sets from below, so
   pairs that can't link are dropped; of the others only a spanning forest
   leaves the task. Its components are the families to verify.
4. Families are dealt as pairs of blocks of bounded size. For each pair of
   blocks the global order is cut into fragments; the partial overlaps in each
   fragment are counted separately and summed per pair. Links leave the task
   as a forest and as counts per document, never as pairs.
5. Components of the forests, spread from classes to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymart.llm import tokens as T
from tallymart.llm.common import documents, dropped, lean, stored
from tallymart.llm.components import components

_U = np.uint64
#: Counters of the frequency sketch: 2**SKETCH_BITS of four bytes (4 MB), whatever the size of the corpus.
SKETCH_BITS = 20
#: Times the mean load of a counter from which a shingle counts as frequent.
HEAVY = 8
#: Documents of a group that one task compares with each other.
GROUP = 8192
#: Documents and shingles of a block in verification; a family's texts are copied once for each of its blocks, so blocks are as large as a task holds.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1 << 21
#: Documents of either side whose overlaps are counted at once within a pair of blocks.
PIECE = 256
#: Columns of an incidence matrix, that is distinct shingles of a fragment.
FRAGMENT = 4096


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The shingle set of each document, in order."""
    for w in T.words(column):
        for i in range(len(w.bounds) - 1):
            yield T.shingle_set(w.hashes[w.bounds[i] : w.bounds[i + 1]], n)


def frequency_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Level of each counter: 0, or the binary logarithm of its load over ``HEAVY`` times the mean load, plus 1.

    Every shingle of every document is counted. Tasks send sparse pieces that
    are summed by piece, so the driver gets the 2**SKETCH_BITS sums and no more.
    """
    size, piece = 1 << SKETCH_BITS, 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for b in batches:
            for s in _sets(b.column("text"), n):
                np.add.at(counts, (s >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
        at = np.arange(0, size, piece)
        yield pa.record_batch({"piece": pa.array(at // piece, pa.int64()), "counts": pa.array([counts[k : k + piece].astype("<u4").tobytes() for k in at], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(piece, dtype=np.int64)
        for b in rows:
            for x in b.column("counts"):
                total += np.frombuffer(x.as_buffer(), dtype="<u4")
        yield pa.record_batch({"piece": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(lean(count), "piece long, counts binary").groupBy("piece").applyInArrow(add, "piece long, counts binary").collect()
    total = np.zeros(size, dtype=np.int64)
    for r in rows:
        total[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["counts"], dtype="<u4")
    mean = max(1.0, float(total.sum()) / size)
    return np.where(total > HEAVY * mean, np.log2(np.maximum(total, 1) / (HEAVY * mean)).astype(np.int64) + 1, 0).clip(0, 127).astype(np.uint8)


def _prefix(s: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first ``n - ceil(t n) + 1`` shingles of a set in the global order (level, hash)."""
    n = len(s)
    keep = n + (-num * n) // den + 1
    if keep <= 0 or n == 0:
        return s[:0]
    level = levels[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]
    if level.any():
        s = s[np.argsort(level, kind="stable")]
    return s[:keep]


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of a power of two of bits, about half as many bits as shingles, 256 at least."""
    bits = max(256, 1 << (max(1, len(s) // 2) - 1).bit_length())
    at = (T.mix(s + _U(0x5BF0_3635)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view("<u8")


def features(docs: DataFrame, n: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """Of each document: size and two digests of its set, prefix, bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2**SKETCH_BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, k1, k2, prefix, bits, cuts = [], [], [], [], [], [0]
            for s in _sets(b.column("text"), n):
                size.append(len(s))
                k1.append(int(T.mix(s + _U(1)).sum(dtype=_U).astype(np.int64)))
                k2.append(int(T.mix(s + _U(2)).sum(dtype=_U).astype(np.int64)))
                prefix.append(_prefix(s, shared.value, num, den).view(np.int64))
                cuts.append(cuts[-1] + len(prefix[-1]))
                bits.append(bitmap(s).tobytes())
            flat = np.concatenate(prefix) if prefix else np.zeros(0, dtype=np.int64)
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"),
                    "n_shingles": pa.array(size, pa.int64()),
                    "k1": pa.array(k1, pa.int64()),
                    "k2": pa.array(k2, pa.int64()),
                    "prefix": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)),
                    "bits": pa.array(bits, pa.binary()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, k1 long, k2 long, prefix array<long>, bits binary")


class Forest:
    """Union-find over 0..n-1, least member as root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _plausible(bits: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None, num: int, den: int) -> Forest:
    """A forest over the documents of a group, with an edge path for every pair that may link.

    ``side``: None, or two blocks of which only pairs across are compared.
    """
    forest = Forest(len(bits))
    widths = np.array([len(b) for b in bits])
    # a longer bitmap folded by XOR is the bitmap of its set at the shorter length
    by: dict[int, np.ndarray] = {}
    for width in np.unique(widths):
        rows = np.flatnonzero(widths >= width)
        by[int(width)] = np.stack([np.bitwise_xor.reduce(bits[i].reshape(-1, width), axis=0) for i in rows])
        at = np.full(len(bits), -1)
        at[rows] = np.arange(len(rows))
        for i in np.flatnonzero(widths == width):
            others = rows[(widths[rows] > width) | (rows > i)]
            a, b = sizes[i], sizes[others]
            others = others[(den * np.minimum(a, b) >= num * np.maximum(a, b))]
            if side is not None:
                others = others[side[others] != side[i]]
            if len(others) == 0:
                continue
            least = np.bitwise_count(by[int(width)][at[others]] ^ by[int(width)][at[i]]).sum(axis=1, dtype=np.int64)
            # |A ^ B| <= (den - num) / (den + num) * (|A| + |B|) for every pair that links
            for j in others[(den + num) * least <= (den - num) * (a + sizes[others])]:
                forest.join(int(i), int(j))
    return forest


def candidate_edges(reps: DataFrame, num: int, den: int, group: int = GROUP) -> DataFrame:
    """Edges (u, v) whose components hold every pair of classes that may link."""
    met = reps.select("rep", F.explode("prefix").alias("shingle"))
    # counted before the shuffle, so a common shingle isn't one task; of shingles whose documents are the same, one stands for all
    part = lambda seed: F.sum(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 31)))
    shared = met.join(met.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1"), "shingle")
    groups = shared.groupBy("shingle", "c").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), part(1).alias("s1"), part(2).alias("s2"))
    groups = groups.groupBy("c", "x", "s1", "s2").agg(F.min("shingle").alias("shingle"))
    met = met.join(groups.select("shingle", "c"), "shingle")
    # a larger group than that goes to all pairs of its blocks; others are a single pair
    met = met.withColumn("nb", F.ceil(F.col("c") / F.lit(group))).withColumn("block", F.pmod(F.xxhash64("rep"), "nb"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    met = met.select("rep", "shingle", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block")
    met = met.join(reps.select("rep", "n_shingles", "bits"), "rep")

    # groups stay whole: rows of one lie together in a partition, and a task carries the last group of a batch on
    met = met.repartition("shingle", "b1", "b2").sortWithinPartitions("shingle", "b1", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            new = pa.Table.from_batches([b])
            start = _last_group(new)
            if waiting and (start or _key(waiting[-1], -1) != _key(new, 0)):
                yield _group_edges(pa.concat_tables([*waiting, new.slice(0, start)]), num, den)
                waiting = []
            elif start:
                yield _group_edges(new.slice(0, start), num, den)
            waiting.append(new.slice(start))
        if waiting:
            yield _group_edges(pa.concat_tables(waiting), num, den)

    return met.mapInArrow(lean(run), "u long, v long")


def _key(t: pa.Table, i: int) -> tuple:
    i %= t.num_rows
    return tuple(t.column(k)[i].as_py() for k in ("shingle", "b1", "b2"))


def _borders(t: pa.Table) -> np.ndarray:
    """The rows where groups begin."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[:1] = True
    for k in ("shingle", "b1", "b2"):
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _last_group(t: pa.Table) -> int:
    return int(_borders(t)[-1])


#: Groups up to this size are compared all at once, without a forest of each.
SMALL = 8


def _group_edges(t: pa.Table, num: int, den: int) -> pa.RecordBatch:
    """Edges (u, v) of all groups of a table that is sorted by group."""
    ids, sizes = t.column("rep").to_numpy(), t.column("n_shingles").to_numpy()
    cross, block = (t.column("b1").to_numpy() != t.column("b2").to_numpy()), t.column("block").to_numpy()
    bits = t.column("bits").combine_chunks()
    begins = _borders(t)
    ends = np.append(begins[1:], t.num_rows)
    group = np.repeat(np.arange(len(begins)), ends - begins)
    small = (ends - begins <= SMALL)[group]
    found = []
    for k in range(1, SMALL):
        i = np.flatnonzero(small[:-k] & (group[:-k] == group[k:])) if len(group) > k else np.zeros(0, dtype=np.int64)
        j = i + k
        ok = (den * np.minimum(sizes[i], sizes[j]) >= num * np.maximum(sizes[i], sizes[j])) & (ids[i] != ids[j]) & (~cross[i] | (block[i] != block[j]))
        found.append((i[ok], j[ok]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    near = np.fromiter((_near(bits[int(x)], bits[int(y)], int(sizes[x] + sizes[y]), num, den) for x, y in zip(i, j, strict=True)), dtype=bool, count=len(i))
    u, v = [ids[i[near]]], [ids[j[near]]]
    for g in np.flatnonzero(ends - begins > SMALL):
        rows = slice(int(begins[g]), int(ends[g]))
        own = [np.frombuffer(x.as_buffer(), dtype="<u8") for x in bits[rows]]
        forest = _plausible(own, sizes[rows], block[rows] if cross[begins[g]] else None, num, den)
        roots = np.array([forest.root(x) for x in range(len(own))])
        on = np.flatnonzero(roots != np.arange(len(own)))
        u.append(ids[rows][on])
        v.append(ids[rows][roots[on]])
    pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
    return pa.record_batch({"u": pa.array(pairs[0], pa.int64()), "v": pa.array(pairs[1], pa.int64())})


def _near(x: pa.Scalar, y: pa.Scalar, both: int, num: int, den: int) -> bool:
    """Whether the bitmaps of two sets, of ``both`` shingles together, allow a link."""
    a, b = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
    width = min(len(a), len(b))
    a, b = (z if len(z) == width else np.bitwise_xor.reduce(z.reshape(-1, width), axis=0) for z in (a, b))
    return (den + num) * int(np.bitwise_count(a ^ b).sum()) <= (den - num) * both


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of two blocks: partial overlaps by fragment of the global order, summed."""
    both = np.concatenate([*left, *right]) if left or right else np.zeros(0, dtype=_U)
    values, counts = np.unique(both, return_counts=True)
    values = values[counts > 1]  # a shingle of one document alone is in no overlap
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for k in range(0, len(values), FRAGMENT):
        fragment = values[k : k + FRAGMENT]
        sides = []
        for block in (left, right):
            m = np.zeros((len(block), len(fragment)), dtype=np.float32)
            for i, s in enumerate(block):
                part = s[np.searchsorted(s, fragment[0]) : np.searchsorted(s, fragment[-1], "right")]
                at = np.searchsorted(fragment, part)
                at = at[fragment[np.minimum(at, len(fragment) - 1)] == part] if len(part) else at
                m[i, at] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total.astype(np.int64)


def verified(members: DataFrame, n: int, num: int, den: int, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc, root, links) from ``members`` (component, rep, text, copies, n_shingles): exact links inside each component."""
    # blocks by hash, of so many documents and shingles on average: no family is ordered in one task
    blocks = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n_shingles") / block_shingles))
    sizes = members.groupBy("component").agg(blocks.alias("blocks"))
    rows = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "rep", "text", "copies")
    # by pairs of blocks: the join before would leave all copies of a family to the task that holds it
    rows = rows.repartition("component", "b1", "b2")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b1, b2 = key[1].as_py(), key[2].as_py()
        ids, copies, sets, block = [], [], [], []
        for b in batches:
            ids.append(b.column("rep").to_numpy())
            copies.append(b.column("copies").to_numpy())
            block.append(b.column("block").to_numpy())
            sets.extend(_sets(b.column("text"), n))
        ids, copies, block = np.concatenate(ids), np.concatenate(copies), np.concatenate(block)
        left, right = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
        sizes = np.array([len(s) for s in sets])
        forest, links = Forest(len(ids)), np.zeros(len(ids), dtype=np.int64)
        pieces = [left[k : k + PIECE] for k in range(0, len(left), PIECE)], [right[k : k + PIECE] for k in range(0, len(right), PIECE)]
        for at, x in enumerate(pieces[0]):
            # a block with itself: each pair of pieces once
            for y in pieces[1][at if b1 == b2 else 0 :]:
                common = overlaps([sets[i] for i in x], [sets[i] for i in y])
                union = sizes[x][:, None] + sizes[y][None, :] - common
                link = (den * common >= num * union) & (common > 0)
                if x[0] == y[0]:
                    np.fill_diagonal(link, False)
                for i, j in zip(*np.nonzero(link), strict=True):
                    forest.join(int(x[i]), int(y[j]))
                links[x] += link @ copies[y]
                if x[0] != y[0]:
                    links[y] += link.T @ copies[x]
        roots = np.array([forest.root(i) for i in range(len(ids))])
        yield pa.record_batch({"doc": pa.array(ids, pa.int64()), "root": pa.array(ids[roots], pa.int64()), "links": pa.array(links, pa.int64())})

    return rows.groupBy("component", "b1", "b2").applyInArrow(run, "doc long, root long, links long")


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, group: int = GROUP, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and n_links (other documents that it links with).

    Two documents link when ``den * intersection >= num * union`` of their sets
    of distinct n-word shingles. ``component_id`` is the least doc_id reachable
    by links, the document included.

    Null or empty texts, and texts without words: empty set, no link, own
    component. Null doc_id: the row is kept; it has the component of the least
    doc_id with an equal set, null if there is none. Rows that repeat a doc_id
    are one node of the graph, and each row is returned. Ties can't arise: all
    comparisons are of integers. An empty table gives an empty table; other
    columns of ``docs`` are not read.
    """
    docs = documents(docs)
    levels = frequency_sketch(docs, n)
    sets = stored(features(docs, n, num, den, levels), "shingle-sets")
    key = ["n_shingles", "k1", "k2"]
    # prefixes and bitmaps go on for one document of a class, and only until candidates are made
    leads = sets.where("n_shingles > 0").groupBy(key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min_by(F.struct("prefix", "bits"), "doc_id").alias("lead"))
    leads = stored(leads.select(*key, "rep", "copies", "lead.prefix", "lead.bits"), "shingle-leads")
    found = stored(sets.select("doc_id", *key), "shingle-keys")
    dropped(sets)
    families = stored(components(candidate_edges(leads.where("rep IS NOT NULL"), num, den, group), "families"), "families")
    classes = stored(leads.select(*key, "rep", "copies"), "shingle-classes")
    dropped(leads)
    members = families.join(classes, families["node"] == classes["rep"]).select("component", "rep", "copies", "n_shingles")
    wanted = docs.join(families.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    members = members.join(wanted, members["rep"] == wanted["doc_id"]).select("component", "rep", "copies", "n_shingles", "text")
    links = stored(verified(members, n, num, den, block_docs), "links")
    linked = components(links.select(F.col("doc").alias("u"), F.col("root").alias("v")), "linked")
    counts = links.groupBy("doc").agg(F.sum("links").alias("links"))
    out = classes.join(linked, classes["rep"] == linked["node"], "left").join(counts, classes["rep"] == counts["doc"], "left")
    out = out.select(*key, F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    some = found.select("doc_id", *key).where("n_shingles > 0").join(out, key)
    some = some.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "n_links")
    none = found.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def representatives(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all their columns, but one of each component: that with the least doc_id.

    Of rows that repeat this doc_id one is kept, the first by its text's hash.
    Rows with a null doc_id stay unless their component has one that isn't null.
    """
    joined = jaccard_join(docs, n, num, den).select(F.col("doc_id").alias("own_id"), "component_id").distinct()
    keep = stored(joined.where("own_id IS NULL AND component_id IS NULL OR own_id = component_id").select("own_id").distinct(), "kept-ids")
    own, rank = "_own", "_rank"
    while {own, rank} & set(docs.columns):
        own, rank = own + "_", rank + "_"
    rows = docs.withColumn(own, F.col("doc_id").cast("long"))
    # the texts are shuffled once: the window finds them parted and in order by the join
    one = rows.join(keep.withColumnRenamed("own_id", own), own, "left_semi")
    one = one.withColumn(rank, F.row_number().over(W.partitionBy(own).orderBy(F.xxhash64("text")))).where(F.col(rank) == 1)
    without = rows.where(F.col(own).isNull()).join(keep.where("own_id IS NULL"), F.lit(True), "left_semi")
    return one.select(*docs.columns).unionByName(without.select(*docs.columns))
