"""What lies around the media files: configuration, cached audio, silence logs, outer tools behind one interface."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import log_duration
from ..workers import ship

#: Extensions of cached audio, best first.
AUDIO_EXTENSIONS = (".mp3", ".m4a", ".wav", ".opus", ".webm")


def load_config(path: str) -> dict:
    """A flat JSON object; no file is an empty one."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def first_setting(*values: str | None, default: str | None = None) -> str | None:
    """The first that is neither None nor empty."""
    return next((v for v in values if v), default)


class MediaTools(Protocol):
    """Programs that read media files, on the path of every executor. ``services.FfmpegTools`` is one; tests use fakes."""

    def duration(self, path: str) -> float | None: ...
    def cut(self, path: str, start_ms: int, end_ms: int, out: str) -> bool: ...
    def silence_lines(self, path: str) -> list[str]: ...


def with_duration(files: DataFrame, make: Callable[[], MediaTools]) -> DataFrame:
    """``files`` (media_id, path) with ``duration`` in seconds, null where it can't be told. Files must be where executors see them."""

    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = make()
        for p in parts:
            yield p.assign(duration=[tools.duration(x) for x in p["path"]])

    ship(files.sparkSession)
    return files.select("media_id", "path").mapInPandas(over, "media_id long, path string, duration double")


def log_lines(files: DataFrame, make: Callable[[], MediaTools]) -> DataFrame:
    """media_id, path -> media_id, pos, line: the silence detector's output, for ``silence_log``."""

    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = make()
        for p in parts:
            rows = [(m, i, line) for m, path in p[["media_id", "path"]].itertuples(index=False) for i, line in enumerate(tools.silence_lines(path))]
            yield pd.DataFrame(rows, columns=["media_id", "pos", "line"])

    ship(files.sparkSession)
    return files.select("media_id", "path").mapInPandas(over, "media_id long, pos int, line string")


def cut_files(cuts: DataFrame, make: Callable[[], MediaTools]) -> DataFrame:
    """media_id, path, start_ms, end_ms, out -> those and ``done``: whether the piece was written to ``out``."""

    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = make()
        for p in parts:
            yield p.assign(done=[tools.cut(*r) for r in p[["path", "start_ms", "end_ms", "out"]].itertuples(index=False)])

    ship(cuts.sparkSession)
    return cuts.select("media_id", "path", "start_ms", "end_ms", "out").mapInPandas(over, "media_id long, path string, start_ms long, end_ms long, out string, done boolean")


def list_audio(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length")


def cached_audio(files: DataFrame, key: Column) -> DataFrame:
    """key, path of the first extension that has a file with bytes in it. ``files``: path, length."""
    rank = F.lit(None).cast("int")
    for i, ext in reversed(list(enumerate(AUDIO_EXTENSIONS))):
        rank = F.when(F.endswith("path", F.lit(ext)), F.lit(i)).otherwise(rank)
    ranked = files.select(key.alias("key"), "path", "length", rank.alias("rank")).where("rank is not null and length > 0")
    w = Window.partitionBy("key").orderBy("rank", "path")
    return ranked.withColumn("n", F.row_number().over(w)).where("n = 1").select("key", "path", "rank")


def silence_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """media_id, pos, line of captured detector output -> (silences of each media by position, durations).

    Starts and ends are matched by position; a start that the detector printed with a minus sign is not seen, as it
    would not match a plain number. Starts that outnumber the ends by one get the duration as an end.
    """
    number = r"(\d+\.?\d*)"
    found = lines.select("media_id", "pos", F.regexp_extract("line", f"silence_start: {number}", 1).try_cast("double").alias("s"), F.regexp_extract("line", f"silence_end: {number}", 1).try_cast("double").alias("e"), log_duration("line").alias("d"))
    durations = found.groupBy("media_id").agg(F.max("d").alias("duration"))
    w = Window.partitionBy("media_id").orderBy("pos")
    starts = found.where("s is not null").select("media_id", (F.row_number().over(w) - 1).alias("n"), "s")
    ends = found.where("e is not null").select("media_id", (F.row_number().over(w) - 1).alias("n"), "e")
    return positional_zip(starts, ends, durations), durations


def positional_zip(starts: DataFrame, ends: DataFrame, durations: DataFrame) -> DataFrame:
    """media_id, pos, s_start, s_end: starts and ends paired by position. ``starts``: media_id, n, s; ``ends``: media_id, n, e; ``durations``: media_id, duration."""
    none = F.lit(None).cast("double")
    both = starts.select("media_id", "n", "s", none.alias("e")).unionByName(ends.select("media_id", "n", none.alias("s"), "e"))
    pick = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("n", c))))
    lists = both.groupBy("media_id").agg(F.transform(pick("s"), lambda x: x["s"]).alias("s"), F.transform(pick("e"), lambda x: x["e"]).alias("e")).join(durations, "media_id", "left")
    ended = F.when((F.size("s") > F.size("e")) & F.col("duration").isNotNull(), F.concat("e", F.array("duration"))).otherwise(F.col("e"))
    pairs = lists.select("media_id", "s", ended.alias("e")).select("media_id", F.posexplode(F.slice(F.arrays_zip("s", "e"), F.lit(1), F.least(F.size("s"), F.size("e")))).alias("pos", "p"))
    return pairs.select("media_id", "pos", F.col("p.s").alias("s_start"), F.col("p.e").alias("s_end"))
