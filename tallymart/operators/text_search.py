"""Search of texts by a trigram posting index, instead of a scan with ILIKE.

The index is two tables, written once. Postings give for a column and three
letters the sorted keys of the rows that hold them, one row per block of keys,
so no list grows with the table; they lie in parts by a hash of the letters.
Texts lie by block. A search reads the parts of its own letters, intersects the
lists of each block, and verifies the candidates on the texts of their blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymart.sources.scratch import kept

#: Rows of a block, parts of the postings, and letters of a gram.
BLOCK, PARTS, GRAM = 1 << 16, 64, 3
#: Where one row in so many is a candidate, the texts of the blocks are read without looking rows up first.
MANY = 8


class TextIndex(NamedTuple):
    """Postings (col_, gram, block, keys, part) and texts (block, key and the columns)."""

    postings: DataFrame
    texts: DataFrame
    key: str
    columns: tuple[str, ...]
    rows: int


def _postings(key: str, columns: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of whole blocks (key, block, columns in lower case) to a row for each column, gram and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[tuple[str, str], list[int]]] = {}
        for b in batches:
            keys, blocks = b.column(key).to_pylist(), b.column("block").to_pylist()
            for c in columns:
                for k, block, text in zip(keys, blocks, b.column(c).to_pylist(), strict=True):
                    lists = found.setdefault(block, {})
                    for g in {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)} if text else ():
                        lists.setdefault((c, g), []).append(k)
        for block, lists in found.items():
            names = list(lists)
            for at in range(0, len(names), 4096):
                some = names[at : at + 4096]
                yield pa.RecordBatch.from_pydict({
                    "col_": pa.array([c for c, _ in some]), "gram": pa.array([g for _, g in some]), "block": pa.array([block] * len(some), pa.int32()),
                    "keys": pa.array([sorted(set(lists[n]), key=lambda k: (k is None, k)) for n in some], pa.list_(pa.int64())),
                })

    return run


def text_index(rows: DataFrame, key: str, columns: tuple[str, ...], path: str, block: int = BLOCK) -> TextIndex:
    """Write the index of some columns of ``rows`` below ``path`` and read it back.

    ``key`` is a whole number and tells rows apart; rows that share it are found
    or not each by their own texts. Null texts are in no list. A block's rows are
    in one task when its lists are made. An empty table gives an empty index.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(key).cast("long").alias(key), *(F.col(c).cast("string").alias(c) for c in columns))
    n = own.count()
    # ranges of as many keys as a block has, however far apart they are
    own = own.repartitionByRange(max(1, -(-n // block)), key).sortWithinPartitions(key).withColumn("block", F.spark_partition_id())
    own.write.partitionBy("block").parquet(f"{path}/texts")
    texts = spark.read.schema(own.schema).parquet(f"{path}/texts")
    low = texts.select(key, "block", *(F.lower(c).alias(c) for c in columns)).repartition(max(1, -(-n // block)), "block")
    lists = low.mapInArrow(_postings(key, columns), "col_ string, gram string, block int, keys array<long>").withColumn("part", (F.crc32(F.col("gram").cast("binary")) % PARTS).cast("int"))
    lists.repartition("part").sortWithinPartitions("gram", "col_", "block").write.partitionBy("part").parquet(f"{path}/postings")
    return TextIndex(spark.read.schema(lists.schema).parquet(f"{path}/postings"), texts, key, columns, n)


def pattern_grams(text: str) -> list[str]:
    """The grams that every text matching ``%text%`` has; none where no three letters stand between wildcards."""
    pieces = re.split(r"[%_\\]", text.lower())
    return sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def matches(columns: tuple[str, ...], text: str) -> Column:
    """Case-insensitive containment in any of the columns; ``%`` and ``_`` in the text stay wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return out


def scan(rows: DataFrame, key: str, columns: tuple[str, ...], text: str) -> DataFrame:
    """What :func:`search` gives, by reading the texts once: for a single search, which an index would cost many times over in time and disk."""
    return rows.where(matches(columns, text)).select(F.col(key).cast("long").alias(key)).distinct()


def search(index: TextIndex, text: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The keys, each once, of the rows of which one of the columns contains ``text`` in any case.

    A text without three letters between wildcards has no list to look up; then
    all texts are read.
    """
    columns = columns or index.columns
    wanted = pattern_grams(text)
    texts = index.texts
    if wanted:
        parts = sorted({zlib.crc32(g.encode()) % PARTS for g in wanted})
        lists = index.postings.where(F.col("part").isin(parts) & F.col("gram").isin(wanted) & F.col("col_").isin(*columns))
        met = lists.groupBy("col_", "block").agg(F.collect_list(F.struct(F.size("keys").alias("n"), "keys")).alias("lists")).where(F.size("lists") == len(wanted))
        shortest = F.transform(F.sort_array("lists"), lambda x: x["keys"])
        both = met.select("block", F.aggregate(F.slice(shortest, 2, len(wanted)), shortest[0], lambda a, b: F.array_intersect(a, b)).alias("keys"))
        found = kept(both.where(F.size("keys") > 0), "candidates")
        told = found.agg(F.sum(F.size("keys")).alias("n"), F.collect_set("block").alias("blocks")).first()
        # as many numbers as the table has blocks, so that no other block is read
        texts = texts.where(F.col("block").isin(told["blocks"]))
        if MANY * (told["n"] or 0) < index.rows:
            texts = texts.join(found.select("block", F.explode("keys").alias(index.key)).distinct(), ["block", index.key], "left_semi")
    return texts.where(matches(columns, text)).select(index.key).distinct()
