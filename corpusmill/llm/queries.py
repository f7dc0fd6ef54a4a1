"""The queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.line_dedup import boilerplate_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.language_model import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.syncmers import fingerprint_neighbours

    return fingerprint_neighbours(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.simhash import simhash_groups

    found = simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, reach=2, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.line_dedup import drop_boilerplate

    return drop_boilerplate(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.embeddings import cosine_components

    return cosine_components(_table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_packing, op3_language_model, op4_license_scan, op5_fingerprints, op6_simhash, op7_quality, op8_mixing, op9_line_dedup, op10_embeddings)
}

ORACLES: dict[str, str] = {"op9_line_dedup": boilerplate_sql()}
