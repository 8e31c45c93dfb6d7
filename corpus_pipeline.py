"""A corpus through five operators, one after the other, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewright.llm.common import release_others, settle, settled_now, table
from cuewright.llm.decontaminate import decontaminate
from cuewright.llm.lines import drop_lines
from cuewright.llm.mixing import mix
from cuewright.llm.quality import keep_good
from cuewright.llm.simhash import one_of_each


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: Links among fingerprints and seeded draws are not for SQL; tests/llm holds run() against a plain loop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage settled on its way goes when its result is there, and so does its input.

    A null or empty text fails the quality rules, so none comes out. Null doc_ids are kept, and rows of one doc_id with
    unlike texts are documents of their own; of rows alike in both, as of any near duplicates, one stays. Extra columns
    pass through whatever their names; the mix adds ``shard`` and ``copy`` (with _ behind where there are such). Empty
    tables give an empty result. Ties fall by doc_id and by hashes, the same in every run.
    """
    docs, before = table(spark, sf_dir, "documents"), settled_now(spark)
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release_others(docs, before)
    return docs
