"""Answers of speech services: words into lines, windows back onto the time line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import duration_text, not_empty_interval, strip

MAX_WORDS, LEAST_WORDS = 12, 5
#: Endings after which a line may close.
LINE_ENDS = ("。", "？", "！", "，", ".", "!", "?", ",", "ครับ", "ค่ะ")


def words_of(response: Column) -> Column:
    """Words of the first alternative of each result; results without words are passed over."""
    per = F.transform(response["results"], lambda r: F.get(r["alternatives"], F.lit(0))["words"])
    return F.flatten(F.filter(per, lambda w: w.isNotNull()))


def transcript_of(response: Column) -> Column:
    """The first alternatives' transcripts, one blank after each (also after a missing one), stripped: the line to use
    where there are no words. Results without alternatives are passed over."""
    heard = F.filter(response["results"], lambda r: F.coalesce(F.size(r["alternatives"]), F.lit(0)) > 0)
    per = F.transform(heard, lambda r: F.concat(F.coalesce(F.get(r["alternatives"], F.lit(0))["transcript"], F.lit("")), F.lit(" ")))
    return strip(F.array_join(per, ""))


def timed_words(responses: DataFrame) -> DataFrame:
    """media_id, seg_index, response -> media_id, seg_index, pos, word, start, end."""
    rows = responses.select("media_id", "seg_index", F.posexplode(words_of(F.col("response"))).alias("pos", "w"))
    return rows.select("media_id", "seg_index", "pos", F.col("w.word").alias("word"), duration_text("w.startTime").alias("start"), duration_text("w.endTime").alias("end"))


def closes_line(word: Column) -> Column:
    out = F.lit(False)
    for e in LINE_ENDS:
        out = out | F.endswith(word, F.lit(e))
    return out


def pack_words(words: DataFrame) -> DataFrame:
    """media_id, seg_index, pos, word, start, end -> media_id, seg_index, line, start, end, text, n_words.

    A line closes at 12 words, or from 5 words on after an ending. The count starts anew at each close, so a fold over
    the words of one window (tens of seconds) finds the cuts.
    """
    w = F.struct("pos", "word", "start", "end", closes_line(F.col("word")).alias("closes"))
    per = words.groupBy("media_id", "seg_index").agg(F.array_sort(F.collect_list(w)).alias("ws"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1
        cut = (n >= MAX_WORDS) | ((n >= LEAST_WORDS) & x["closes"])
        return F.struct(F.when(cut, 0).otherwise(n).alias("n"), F.concat(acc["sizes"], F.when(cut, F.array(n)).otherwise(F.array().cast("array<int>"))).alias("sizes"))

    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("sizes"))
    sizes = F.aggregate("ws", zero, step, lambda a: F.concat(a["sizes"], F.when(a["n"] > 0, F.array(a["n"])).otherwise(F.array().cast("array<int>"))))
    lines = per.withColumn("sizes", sizes).select("media_id", "seg_index", "ws", "sizes", F.posexplode("sizes").alias("line", "n_words"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("line")), F.lit(0), lambda a, x: a + x)
    lines = lines.withColumn("ws", F.slice("ws", before + 1, F.col("n_words")))
    start, end = F.get("ws", F.lit(0))["start"], F.get("ws", F.col("n_words") - 1)["end"]
    return lines.select("media_id", "seg_index", "line", start.alias("start"), end.alias("end"), F.array_join(F.transform("ws", lambda x: x["word"]), " ").alias("text"), "n_words")


def onto_timeline(lines: DataFrame, offset_seconds: Column, repair: bool = False) -> DataFrame:
    """Times within a window as times of the recording; ``repair`` gives lines that do not last two seconds."""
    out = lines.withColumns({"start": F.col("start") + offset_seconds, "end": F.col("end") + offset_seconds})
    return out.withColumn("end", not_empty_interval("start", "end")) if repair else out
