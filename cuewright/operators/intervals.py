"""Operators on the time line: complement of silence, windows, splits, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import to_ms

OVERLAP_MS, LEAST_MS = 10_000, 5_000
WHISPER_MAX_MS, GOOGLE_MAX_MS = 600_000, 59_000
PADDING_MS = 200


def gap_complement(silences: DataFrame, media: DataFrame) -> DataFrame:
    """media_id, s, e: what lies between silences, up to the end of the recording.

    ``silences``: media_id, pos, s_start, s_end; ``media``: media_id, duration. Each gap starts where the silence before
    ended (also if an earlier one ended later). A first silence before 0.1 s leaves no gap ahead of it.
    """
    w = Window.partitionBy("media_id").orderBy("s_start", "pos")
    rows = silences.select("media_id", F.lag("s_end", 1, 0.0).over(w).alias("s"), F.col("s_start").alias("e"), F.row_number().over(w).alias("rn"))
    gaps = rows.where((F.col("e") > F.col("s")) & ~((F.col("rn") == 1) & (F.col("e") < F.lit(0.1)))).select("media_id", "s", "e")
    last = silences.groupBy("media_id").agg(F.max_by("s_end", F.struct("s_start", "pos")).alias("s"))
    tail = media.join(last, "media_id", "left").select("media_id", F.coalesce("s", F.lit(0.0)).alias("s"), F.col("duration").alias("e")).where("e > s")
    return gaps.unionByName(tail)


def padded_ms(gaps: DataFrame, media: DataFrame, padding: int = PADDING_MS) -> DataFrame:
    """media_id, start_ms, end_ms of gaps in seconds, padded and clamped to the recording; empty ones go."""
    both = gaps.join(media, "media_id")
    out = both.select("media_id", F.greatest(F.lit(0), to_ms("s") - padding).cast("bigint").alias("start_ms"), F.least(to_ms("duration"), to_ms("e") + padding).alias("end_ms"))
    return out.where("end_ms > start_ms")


def speech_segments(silences: DataFrame, media: DataFrame, padding: int = PADDING_MS) -> DataFrame:
    """media_id, seg_index, start_ms, end_ms."""
    rows = padded_ms(gap_complement(silences, media), media, padding)
    w = Window.partitionBy("media_id").orderBy("start_ms", "end_ms")
    return rows.withColumn("seg_index", (F.row_number().over(w) - 1).cast("int")).select("media_id", "seg_index", "start_ms", "end_ms")


def window_starts(start: Column, end: Column, longest: int) -> Column:
    if longest <= 0:
        raise ValueError("the longest window must be positive")
    stride = max(longest - OVERLAP_MS, longest // 2, 1)
    return F.when(end > start, F.sequence(start, end - 1, F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def overlapping_windows(spans: DataFrame, longest: int) -> DataFrame:
    """``spans`` with start_ms, end_ms -> w_start, w_end of windows of ``longest`` ms, a stride apart; short ones go unless first."""
    start, end = F.col("start_ms"), F.col("end_ms")
    at = spans.withColumn("w_start", F.explode(window_starts(start, end, longest))).withColumn("w_end", F.least(F.col("w_start") + longest, end))
    return at.where((F.col("w_end") - F.col("w_start") >= LEAST_MS) | (F.col("w_start") == start))


def split_long(spans: DataFrame, longest: int) -> DataFrame:
    """As ``overlapping_windows`` for spans over ``longest``; the others stay whole."""
    start, end = F.col("start_ms"), F.col("end_ms")
    starts = F.when(end - start <= longest, F.array(start)).otherwise(window_starts(start, end, longest))
    at = spans.withColumn("w_start", F.explode(starts)).withColumn("w_end", F.when(end - start <= longest, end).otherwise(F.least(F.col("w_start") + longest, end)))
    return at.where((F.col("w_end") - F.col("w_start") >= LEAST_MS) | (F.col("w_start") == start))


def equal_parts(files: DataFrame, limit_mb: int = 24, target_mb: int = 20) -> DataFrame:
    """``files`` with size (bytes), duration -> part, n_parts, part_start, part_seconds; up to the limit one whole part."""
    mb = 1024.0 * 1024.0
    n = F.when(F.col("size") <= limit_mb * mb, F.lit(1)).otherwise(F.ceil(F.col("size") / F.lit(mb) / target_mb)).cast("bigint")
    out = files.withColumn("n_parts", n).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_parts") - 1)))
    each = F.col("duration") / F.col("n_parts")
    return out.withColumns({"part_start": F.col("part") * each, "part_seconds": each})


def running_offset(parts: DataFrame, duration: str, order: str) -> DataFrame:
    """``offset``: the summed durations of the parts before, by media."""
    w = Window.partitionBy("media_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(duration).over(w), F.lit(0)))
