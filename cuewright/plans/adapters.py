"""Test tables seen as recordings and their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONTH_SECONDS = 2_592_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a recording; each turn lasts 66 ms a character."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("idx"), "role", "text", (F.length(F.coalesce("text", F.lit(""))) * 66).cast("bigint").alias("dur"))
    w = Window.partitionBy("media_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("start_ms", F.coalesce(F.sum("dur").over(w), F.lit(0)))
    return c.select("media_id", "idx", "role", "text", (F.col("start_ms") / F.lit(1000.0)).alias("start"), ((F.col("start_ms") + F.col("dur")) / F.lit(1000.0)).alias("end"))


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a recording, each line two seconds after the one before."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return d.select("media_id", F.col("idx").cast("bigint").alias("idx"), (F.col("idx") * F.lit(2.0)).alias("start"), (F.col("idx") * F.lit(2.0) + F.lit(1.5)).alias("end"), "text")


def _seconds() -> Column:
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(1e6)


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("idx"), _seconds().alias("start"), (_seconds() + F.col("value")).alias("end"), F.concat("event_type", "props").alias("text"))


def silences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Errors as silences, and the recordings (one for each user) with their duration."""
    e = table(spark, sf_dir, "events")
    s = e.where("event_type = 'error'").select(F.col("user_id").alias("media_id"), F.col("event_id").cast("int").alias("pos"), _seconds().alias("s_start"), (_seconds() + F.col("value")).alias("s_end"))
    return s, e.select(F.col("user_id").alias("media_id")).distinct().withColumn("duration", F.lit(float(MONTH_SECONDS)))


def document_words(spark: SparkSession, sf_dir: str, per_window: int = 150) -> DataFrame:
    """The words of a document, 400 ms apart, in windows of 150."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "[ \n]+"), lambda x: x != "")).alias("n", "word"))
    ms = F.col("n") * 400
    return d.select(F.col("doc_id").alias("media_id"), F.floor(F.col("n") / per_window).cast("int").alias("seg_index"), F.pmod("n", F.lit(per_window)).cast("int").alias("pos"), "word", (ms / F.lit(1000.0)).alias("start"), ((ms + 350) / F.lit(1000.0)).alias("end"))
