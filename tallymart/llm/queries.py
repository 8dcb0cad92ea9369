"""Queries of this subpackage for the driver, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm.common import table


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.lm_scoring import lm_scores

    found = lm_scores(table(spark, sf_dir, "documents"))
    return found.withColumn("log_score", F.round("log_score", 4)).withColumn("mean_score", F.round("mean_score", 6))


def op2_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.html_extract import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text")


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.ngram_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.media import stored_media

    return stored_media(table(spark, sf_dir, "documents"))


def op8_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.sharding import sharded

    return sharded(table(spark, sf_dir, "documents"), limit=1 << 20)


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.warc_zip import archived

    return archived(table(spark, sf_dir, "pages"))


def op10_toxicity_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.manifest import audited

    return audited(table(spark, sf_dir, "documents"), folds=5)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.quality_rules import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallymart.llm.vector_codes import coded

    return coded(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from tallymart.llm import lm_scoring, manifest, quality_rules, sharding, vector_codes, warc_zip

    return {
        "op1_stupid_backoff": lm_scoring.ORACLE,
        "op8_extendible_hashing": sharding.ORACLE,
        "op9_warc_zip": warc_zip.ORACLE,
        "op11_merkle_manifest": manifest.ORACLE,
        "op12_quality_rules": quality_rules.ORACLE,
        "op13_yinyang_codes": vector_codes.ORACLE,
    }
