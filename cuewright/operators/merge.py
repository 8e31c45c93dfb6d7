"""Joining two lists of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def two_lines(top: Column, bottom: Column) -> Column:
    """The texts that are not blank, one above the other."""
    line = lambda c: F.nullif(strip(c), F.lit(""))
    return F.concat_ws("\n", line(top), line(bottom))


def positional_merge(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Row i of both lists as one: the original's timing where it has a row i, the translation's text above the original's."""
    o = original.select("media_id", "idx", F.struct("start", "end", "text").alias("o"))
    t = translated.select("media_id", "idx", F.struct("start", "end", "text").alias("t"))
    both = o.join(t, ["media_id", "idx"], "full")
    at = F.coalesce("o", "t")
    return both.select("media_id", "idx", at["start"].alias("start"), at["end"].alias("end"), two_lines(F.col("t.text"), F.col("o.text")).alias("text"))


def merge_within(segments: DataFrame, top: Column, bottom: Column) -> DataFrame:
    """``positional_merge`` of two selections of one table, with one shuffle: rows of either are numbered as they come by idx."""
    cue = F.struct("idx", "start", "end", "text")
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, cue)))
    both = segments.groupBy("media_id").agg(pick(bottom).alias("o"), pick(top).alias("t"))
    rows = both.select("media_id", F.posexplode(F.arrays_zip("o", "t")).alias("idx", "p"))
    at = F.coalesce("p.o", "p.t")
    return rows.select("media_id", F.col("idx").cast("bigint").alias("idx"), at["start"].alias("start"), at["end"].alias("end"), two_lines(F.col("p.t.text"), F.col("p.o.text")).alias("text"))
