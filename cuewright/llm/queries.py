"""The corpus queries: each applies one operator, as it would run in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import debruijn, decontaminate, lines, mixing, pii, quality, quality_model, simhash, sql, suffix_array, toxicity
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonym_rows(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.byte_digest(table(spark, sf_dir, "documents"))


def op8_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.word_digest(table(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_mixing, op3_quality_rules, op4_pii, op5_simhash, op6_toxicity, op7_suffix_array, op8_debruijn, op9_quality_model, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": sql.OP1, "op3_quality_rules": sql.op3(quality.STOP_WORDS), "op7_suffix_array": sql.OP7, "op8_debruijn": sql.OP8, "op10_line_dedup": sql.OP10}
