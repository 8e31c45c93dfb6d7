"""Segments in batches for a language model, and its answers back in their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..model import RESPONSE

BATCH, CONTEXT = 15, 3


def batches(segments: DataFrame, size: int = BATCH) -> DataFrame:
    """``batch_no`` and ``local_id`` by position within the media; ``idx`` without gaps is the position."""
    return segments.withColumns({"batch_no": F.floor(F.col("idx") / size).cast("bigint"), "local_id": F.pmod("idx", F.lit(size)).cast("int")})


def last_texts(texts: Column, n: int = CONTEXT) -> Column:
    """The last ``n``; a slice from -n on gives nothing where there are fewer."""
    k = F.least(F.lit(n), F.size(texts))
    return F.when(k > 0, F.slice(texts, -k, k)).otherwise(F.array().cast("array<string>"))


def _with_context(batched: DataFrame, n: int) -> DataFrame:
    """media_id, batch_no, segments (of the batch, in order), context."""
    per = batched.groupBy("media_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct(F.col("local_id").alias("id"), "start", "end", "text"))).alias("segments"))
    tail = F.array_join(last_texts(F.transform("segments", lambda x: x["text"]), n), "\n")
    w = Window.partitionBy("media_id").orderBy("batch_no")
    return per.withColumn("_tail", tail).withColumn("context", F.nullif(F.lag("_tail").over(w), F.lit(""))).drop("_tail")


def batch_context(batched: DataFrame, n: int = CONTEXT) -> DataFrame:
    """media_id, batch_no, context: the last texts of the batch before; null for the first or if they are all empty.

    Contexts are original texts, so all batches can be asked at once.
    """
    return _with_context(batched, n).select("media_id", "batch_no", "context")


def requests(batched: DataFrame, n: int = CONTEXT) -> DataFrame:
    """media_id, batch_no, request (JSON): the batch's segments and, if there is one, the context."""
    body = F.struct(F.col("context").alias("previous_context_for_reference_only"), F.col("segments").alias("segments_to_translate"))
    return _with_context(batched, n).select("media_id", "batch_no", F.to_json(body).alias("request"))


def answers(responses: DataFrame) -> DataFrame:
    """media_id, batch_no, response (JSON) -> media_id, batch_no, local_id, translated; the last of equal ids, none without id or text."""
    items = responses.select("media_id", "batch_no", F.posexplode(F.from_json("response", RESPONSE)["segments"]).alias("pos", "s")).where("s.id is not null and s.text is not null")
    return items.groupBy("media_id", "batch_no", F.col("s.id").alias("local_id")).agg(F.max_by("s.text", "pos").alias("translated"))


def complete_batches(batched: DataFrame, answered: DataFrame) -> DataFrame:
    """media_id, batch_no, complete: as many ids as segments (ids are not compared)."""
    n = batched.groupBy("media_id", "batch_no").agg(F.count(F.lit(1)).alias("n"))
    got = answered.groupBy("media_id", "batch_no").agg(F.count(F.lit(1)).alias("got"))
    return n.join(got, ["media_id", "batch_no"], "left").select("media_id", "batch_no", (F.col("n") == F.coalesce("got", F.lit(0))).alias("complete"))


def realign(batched: DataFrame, answered: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Each segment with its answer; else ``fallback`` (a non-blank text), else its own text. Timing stays the original's."""
    both = batched.join(answered, ["media_id", "batch_no", "local_id"], "left")
    second = F.nullif(strip(fallback), F.lit("")) if fallback is not None else F.lit(None).cast("string")
    return both.withColumns({"from_batch": F.col("translated").isNotNull(), "text": F.coalesce("translated", second, "text")}).drop("translated")
