"""Registered queries of the training-data operators."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, hard_negatives, idfile, langid, mixing, packing, pii, quality, recompression, simhash, substring_dedup, toxicity, vector_codes
from .common import shared_folder, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality(table(spark, sf_dir, "documents")).select(*columns)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's spark.kgspark.surrogates.key; without one each run draws its own."""
    key = spark.conf.get("spark.kgspark.surrogates.key", None) or secrets.token_hex(32)
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_entities", "kinds")


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.id_files(table(spark, sf_dir, "documents"), shared_folder(spark))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.word_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.moved_labels(table(spark, sf_dir, "embeddings")))


OPERATORS = (
    op1_substring_dedup,
    op2_language_id,
    op3_quality,
    op4_packing,
    op5_pii,
    op6_id_files,
    op7_simhash,
    op8_toxicity,
    op9_exact_dedup,
    op10_mixing,
    op11_vector_codes,
    op12_word_dedup,
    op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality": quality.ORACLE_SQL,
        "op9_exact_dedup": exact_dedup.ORACLE_SQL,
        "op10_mixing": mixing.ORACLE_SQL,
        "op11_vector_codes": vector_codes.ORACLE_SQL,
        "op12_word_dedup": recompression.ORACLE_SQL,
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
