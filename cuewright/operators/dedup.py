"""Repeated text in segment lists: over-frequent texts, runs, starts that nearly coincide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

MAX_REPEAT, MAX_SHARE, MAX_NO_SPEECH = 5, 0.15, 0.9
NEAR_SECONDS = 1.0
#: Kept rows that are gathered before they are put away.
PART = 256


def flag_frequent(segments: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``frequent``: the stripped text makes up more than ``max_repeat`` rows and 15% of its media's rows; never if empty.

    Both counts and what follows by media plan to one exchange on the media; a recording's segments fit one task.
    """
    rows = segments.withColumn("_key", strip(F.coalesce("text", F.lit(""))))
    same, total = (F.count(F.lit(1)).over(Window.partitionBy(*by)) for by in (["media_id", "_key"], ["media_id"]))
    rows = rows.withColumns({"_n": same, "_total": total})
    return rows.withColumn("frequent", (F.col("_key") != "") & (F.col("_n") > max_repeat) & (F.col("_n") > F.lit(MAX_SHARE) * F.col("_total"))).drop("_key", "_n", "_total")


def drop_frequent(segments: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    return flag_frequent(segments, max_repeat).where("not frequent").drop("frequent")


def collapse_runs(segments: DataFrame) -> DataFrame:
    """Of neighbours with one stripped text the first stays."""
    w = Window.partitionBy("media_id").orderBy("idx")
    rows = segments.withColumn("_key", strip(F.coalesce("text", F.lit(""))))
    return rows.withColumn("_before", F.lag("_key").over(w)).where(~F.col("_key").eqNullSafe(F.col("_before"))).drop("_key", "_before")


def filter_hallucinations(segments: DataFrame, max_repeat: int = MAX_REPEAT, no_speech: str | None = None) -> DataFrame:
    """Without empty, likely silent, over-frequent and run-on texts, in that order; counts are taken before anything goes."""
    rows = flag_frequent(segments, max_repeat)
    keep = (strip(F.coalesce("text", F.lit(""))) != "") & ~F.col("frequent")
    if no_speech:
        keep = keep & (F.coalesce(F.col(no_speech), F.lit(0.0)) <= F.lit(MAX_NO_SPEECH))
    return collapse_runs(rows.where(keep).drop("frequent"))


def near_duplicate_starts(segments: DataFrame, seconds: float | Column = NEAR_SECONDS) -> DataFrame:
    """Of segments that start within ``seconds`` of the last kept one, the longer text stays and becomes that one.

    A start that is ``seconds`` or more after the one before it begins an island that no earlier row can reach, so the
    fold runs over islands, not over whole media. What is kept is gathered in parts, as each step copies the part it adds
    to: an island of n rows costs in proportion to n, until n / ``PART`` is some thousands too.
    """
    thr = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    w = Window.partitionBy("media_id").orderBy("start", "idx")
    rows = segments.where("start is not null and not isnan(start)").withColumn("_new", F.coalesce(F.col("start") - F.lag("start").over(w) >= thr, F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    # Whole rows travel in the fold, so nothing is joined back; one exchange on the media in all.
    item = F.struct("start", "idx", F.char_length(strip(F.coalesce("text", F.lit("")))).alias("n"), F.struct(*segments.columns).alias("row"))
    kind = rows.select(item.alias("x")).schema["x"].dataType.simpleString()
    per = rows.groupBy("media_id", "_island").agg(F.array_sort(F.collect_list(item)).alias("_rows"))

    def step(acc: Column, x: Column) -> Column:
        held, part = acc["held"], F.concat(acc["part"], F.array(acc["held"]))
        near = F.abs(x["start"] - held["start"]) < thr
        keep = F.when(held.isNull() | ~near | (x["n"] > held["n"]), x).otherwise(held)
        ends = held.isNotNull() & ~near  # what was held is done
        full = ends & (F.size(part) >= PART)
        none = F.array().cast(f"array<{kind}>")
        return F.struct(keep.alias("held"), F.when(full, none).when(ends, part).otherwise(acc["part"]).alias("part"), F.when(full, F.concat(acc["done"], F.array(part))).otherwise(acc["done"]).alias("done"))

    zero = F.struct(F.lit(None).cast(kind).alias("held"), F.array().cast(f"array<{kind}>").alias("part"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    kept = F.aggregate("_rows", zero, step, lambda a: F.flatten(F.concat(a["done"], F.array(F.concat(a["part"], F.array(a["held"]))))))
    return per.select(F.explode(kept).alias("x")).select("x.row.*")
