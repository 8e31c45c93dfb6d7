"""An extension of our own: segments as a stream. All of it works on bounded tables too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_timestamp, strip


def rendered_stream(segments: DataFrame) -> DataFrame:
    """Segments (media_id, start, end, text) as timed lines; blank texts go. Stateless."""
    return segments.where(strip("text") != "").select("media_id", F.concat(format_timestamp("start"), F.lit(" --> "), format_timestamp("end")).alias("time"), strip("text").alias("text"))


def first_arrivals(segments: DataFrame, event_time: str, late: str = "10 minutes") -> DataFrame:
    """Each (media_id, start, text) once, though overlapping windows or retries deliver it again within ``late``."""
    return segments.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["media_id", "start", "text"])


def arrivals_per_window(segments: DataFrame, event_time: str, width: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.window(event_time, width, slide)
    return segments.withWatermark(event_time, late).groupBy(w.alias("w"), "media_id").agg(F.count(F.lit(1)).alias("n")).select("media_id", F.col("w.start").alias("from_time"), F.col("w.end").alias("to_time"), "n")
