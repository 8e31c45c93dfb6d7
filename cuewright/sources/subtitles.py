"""WebVTT and SRT: files to segments and back.

A file is one row; it is parsed by split, filter and explode, so files spread over tasks and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clock_seconds, format_timestamp, one_line_ends, srt_seconds, strip

ARROW = "-->"


def read_files(spark: SparkSession, path: str, media_id: Column | None = None) -> DataFrame:
    """media_id (a hash of the path unless given), path, content."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return raw.select((media_id if media_id is not None else F.xxhash64("path")).alias("media_id"), "path", "content")


def _numbered(cues: DataFrame) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy("_pos")
    return cues.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))


def _range(line: Column, seconds, settings: bool) -> tuple[Column, Column, Column]:
    """(start, end, well-formed) of a time line; with ``settings`` what follows the end after a blank is not part of it."""
    sides = F.split(line, f" {ARROW} ", -1)
    end = F.get(sides, F.lit(1))
    start, end = seconds(F.get(sides, F.lit(0))), seconds(F.get(F.split(end, " "), F.lit(0)) if settings else end)
    return start, end, (F.size(sides) == 2) & start.isNotNull() & end.isNotNull()


def parse_vtt(files: DataFrame) -> DataFrame:
    """``content`` -> media_id, idx, start, end, text. Malformed cues are left out; cues without text stay.

    A block's first line is looked at as it is, so one that begins with an empty line or a blank is no note.
    """
    blocks = files.select("media_id", F.posexplode(F.split(strip(one_line_ends("content")), "\n\n")).alias("_pos", "_block"))
    lines = blocks.select("media_id", "_pos", F.split("_block", "\n").alias("_lines"))
    first = F.get("_lines", F.lit(0))
    lines = lines.where(~((strip(first) == "WEBVTT") | F.startswith(first, F.lit("NOTE"))))
    at = F.array_position(F.transform("_lines", lambda x: F.contains(x, F.lit(ARROW))), True)
    timed = lines.withColumn("_at", at.cast("int")).where("_at > 0")
    start, end, good = _range(F.get("_lines", F.col("_at") - 1), clock_seconds, True)
    text = strip(F.array_join(F.slice("_lines", F.col("_at") + 1, F.size("_lines")), "\n"))
    cues = timed.select("media_id", "_pos", start.alias("start"), end.alias("end"), text.alias("text"), good.alias("_good")).where("_good")
    return _numbered(cues).select("media_id", "idx", "start", "end", "text")


def parse_srt(files: DataFrame, mode: str = "failfast") -> DataFrame:
    """As ``parse_vtt`` for SRT, where nothing may follow the end. Blocks of fewer than three lines go. A malformed time
    stops the query whatever columns it reads ("failfast"), or empties its file ("quarantine"), or drops its cue ("permissive")."""
    if mode not in ("failfast", "quarantine", "permissive"):
        raise ValueError(f"mode {mode!r}")
    blocks = files.select("media_id", F.posexplode(F.split(strip(one_line_ends("content")), "\n\n+")).alias("_pos", "_block"))
    lines = blocks.select("media_id", "_pos", F.split(strip("_block"), "\n").alias("_lines"))
    line = F.get("_lines", F.lit(1))
    is_cue = F.coalesce((F.size("_lines") >= 3) & F.contains(line, F.lit(ARROW)), F.lit(False))
    start, end, good = _range(line, srt_seconds, False)
    if mode == "failfast":
        wrong = F.raise_error(F.concat(F.lit("malformed time line: "), line)).cast("boolean")
        lines = lines.where(F.when(~is_cue, False).when(good, True).otherwise(wrong))
    cues = lines.where(is_cue).select("media_id", "_pos", start.alias("start"), end.alias("end"), F.array_join(F.slice("_lines", F.lit(3), F.size("_lines")), "\n").alias("text"), good.alias("_good"))
    if mode == "quarantine":
        cues = cues.withColumn("_good", F.min("_good").over(Window.partitionBy("media_id"))).where("_good")
    elif mode == "permissive":
        cues = cues.where("_good")
    return _numbered(cues).select("media_id", "idx", "start", "end", "text")


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    return parse_vtt(read_files(spark, path))


def read_srt(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """Segments of SRT files; a path without files gives none."""
    try:
        return parse_srt(read_files(spark, path), mode)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "media_id long, idx long, start double, end double, text string")


def parse_by_name(files: DataFrame, other: str | None = None, mode: str = "failfast") -> DataFrame:
    """media_id, path, content by extension, with its case: .vtt, .srt; anything else as ``other`` says ("srt") or nothing."""
    vtt = F.endswith("path", F.lit(".vtt"))
    srt = ~vtt if other == "srt" else F.endswith("path", F.lit(".srt"))
    return parse_vtt(files.where(vtt)).unionByName(parse_srt(files.where(srt), mode))


def read_subtitles(spark: SparkSession, path: str, other: str | None = None, mode: str = "failfast") -> DataFrame:
    return parse_by_name(read_files(spark, path), other, mode)


def cue_block(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), format_timestamp(start), F.lit(f" {ARROW} "), format_timestamp(end), F.lit("\n"), strip(F.coalesce(text, F.lit(""))), F.lit("\n\n"))


def render_srt(segments: DataFrame) -> DataFrame:
    """One row for each media: media_id, content. Numbers go by position from 1."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "start", "end", "text")))
    blocks = F.transform(F.col("cues"), lambda x, i: cue_block(i + 1, x["start"], x["end"], x["text"]))
    return segments.groupBy("media_id").agg(ordered.alias("cues")).select("media_id", F.array_join(blocks, "").alias("content"))


def write_srt(segments: DataFrame, path: str) -> None:
    """A folder for each media below ``path``, with one text file in it."""
    rendered = render_srt(segments)
    # The text sink ends each row with a line feed of its own.
    rendered.select("media_id", F.regexp_replace("content", "\n\\z", "").alias("value")).write.partitionBy("media_id").text(path)


def output_names(title: Column, language: Column) -> tuple[Column, Column]:
    """Names of the translated and the bilingual file."""
    return F.concat(title, F.lit("."), language, F.lit(".srt")), F.concat(title, F.lit("."), language, F.lit(".bilingual.srt"))
