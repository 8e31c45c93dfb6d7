"""Speech and translation services behind small interfaces, run in tasks; deterministic fakes for use without a network.

Every answer comes with ``error``: null, or why the last call failed. Answers cost money: a task that is tried again asks
again, and so does each use of a lazy frame. What is to be used twice is settled first (the pipelines do), and
speculative execution is to stay off.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.batching import answers, batches, complete_batches, realign, requests
from .operators.intervals import running_offset
from .workers import ship


class Translator(Protocol):
    def batch(self, request: str) -> str:
        """A request (JSON) to an answer (JSON, model.RESPONSE)."""

    def single(self, text: str) -> str | None: ...


class Transcriber(Protocol):
    def window(self, media_id: int, start_ms: int, end_ms: int) -> list[dict]:
        """{start, end, text} in seconds from the window's start."""


class PartTranscriber(Protocol):
    def part(self, media_id: int, part: int, start: float, seconds: float) -> tuple[list[dict], float | None]:
        """As ``Transcriber.window`` for a part of a file (``seconds`` None: the whole), and the part's own duration."""


class ServiceError(RuntimeError):
    """Every call failed: nothing came of it, and the first reason is in the message."""


def fail_if_all_failed(asked: DataFrame) -> None:
    """``asked``: a settled table with ``error``."""
    n, failed, why = asked.agg(F.count(F.lit(1)), F.count("error"), F.min("error")).first()
    if n and n == failed:
        raise ServiceError(f"all {n} calls failed, one with: {why}")


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


class FakeTranslator:
    """Puts a mark before each text; leaves out every fifth, answers the first twice, and has a second chance for half of the missing."""

    def batch(self, request: str) -> str:
        items = json.loads(request)["segments_to_translate"]
        out = [{"id": s["id"], "start": s["start"], "end": s["end"], "text": f"[x] {s['text']}"} for s in items if s["id"] % 5 != 3]
        return json.dumps({"segments": [dict(s, text="?") for s in out[:1]] + out}, ensure_ascii=False)

    def single(self, text: str) -> str | None:
        return f"({text})" if len(text) % 2 else "  "


def _complete(request: str, response: str) -> bool:
    """As many ids answered as asked; only the numbers are compared."""
    ids = {s["id"] for s in json.loads(response).get("segments", []) if s.get("id") is not None and s.get("text") is not None}
    return len(ids) == len(json.loads(request)["segments_to_translate"])


def ask_batches(asked: DataFrame, make: Callable[[], Translator], attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """media_id, batch_no, request -> media_id, batch_no, response, attempts, error: the last answer that could be read,
    null if there was none; ``error`` is why the last attempt failed, if it did."""

    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = make()

        def one(request: str) -> tuple[str | None, int, str | None]:
            got = error = None
            for i in range(attempts):
                try:
                    answer = t.batch(request)
                    done, error = _complete(request, answer), None
                    got = answer
                except Exception as e:  # a service may fail in any way; the batch falls back to single texts  # noqa: BLE001
                    done, error = False, _said(e)
                if done:
                    break
                if i + 1 < attempts:
                    time.sleep(pause)
            return got, i + 1, error

        for p in parts:
            rows = [one(r) for r in p["request"]]
            yield p[["media_id", "batch_no"]].assign(response=[r[0] for r in rows], attempts=[r[1] for r in rows], error=[r[2] for r in rows])

    ship(asked.sparkSession)
    return asked.mapInPandas(over, "media_id long, batch_no long, response string, attempts int, error string")


def ask_singles(missing: DataFrame, make: Callable[[], Translator], attempts: int = 2, pause: float = 0.5) -> DataFrame:
    """media_id, idx, text -> media_id, idx, second (null if there was no answer that is not blank), error."""

    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = make()

        def one(text: str) -> tuple[str | None, str | None]:
            error = None
            for _ in range(attempts):
                time.sleep(pause)
                try:
                    error = None
                    if got := (t.single(text) or "").strip():
                        return got, None
                except Exception as e:  # noqa: BLE001
                    error = _said(e)
            return None, error

        for p in parts:
            rows = [one(x) for x in p["text"]]
            yield p[["media_id", "idx"]].assign(second=[r[0] for r in rows], error=[r[1] for r in rows])

    ship(missing.sparkSession)
    return missing.mapInPandas(over, "media_id long, idx long, second string, error string")


def translated(segments: DataFrame, make: Callable[[], Translator], batch: int = 15, pause: float = 1.0) -> DataFrame:
    """media_id, idx, start, end, text (translated), source ("batch", "single", or "original" if no answer came), error.

    Timing stays the original's. Batches are asked in parallel: their contexts are original texts.
    """
    parts = batches(segments, batch)
    asked = ask_batches(requests(parts), make, pause=pause)
    done = realign(parts, answers(asked))
    second = ask_singles(done.where("not from_batch").select("media_id", "idx", "text"), make, pause=pause / 2)
    both = done.join(second, ["media_id", "idx"], "left")
    source = F.when(F.col("from_batch"), "batch").when(F.col("second").isNotNull(), "single").otherwise("original")
    return both.select("media_id", "idx", "start", "end", F.coalesce("second", "text").alias("text"), source.alias("source"), "error")


def translate(segments: DataFrame, make: Callable[[], Translator], batch: int = 15, pause: float = 1.0) -> DataFrame:
    """``segments`` with translated texts and the same timing; a text without an answer stays."""
    return translated(segments, make, batch, pause).select("media_id", "idx", "start", "end", "text")


HEARD = "media_id long, seg_index int, start_ms long, end_ms long, segments array<struct<start:double,end:double,text:string>>, error string"


def hear(windows: DataFrame, make: Callable[[], Transcriber]) -> DataFrame:
    """media_id, seg_index, start_ms, end_ms -> those, segments (seconds from the window's start; null if the call failed), error.

    ``windows.repartition(n)`` sets how many calls run at once.
    """

    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = make()

        def one(m: int, s: int, e: int) -> tuple[list[dict] | None, str | None]:
            try:
                return [{"start": float(x["start"]), "end": float(x["end"]), "text": x["text"]} for x in t.window(m, s, e)], None
            except Exception as err:  # noqa: BLE001
                return None, _said(err)

        for p in parts:
            rows = [one(*r) for r in p[["media_id", "start_ms", "end_ms"]].itertuples(index=False)]
            yield p[["media_id", "seg_index", "start_ms", "end_ms"]].assign(segments=[r[0] for r in rows], error=[r[1] for r in rows])

    ship(windows.sparkSession)
    return windows.select("media_id", "seg_index", "start_ms", "end_ms").mapInPandas(over, HEARD)


def on_timeline(heard: DataFrame) -> DataFrame:
    """Rows of ``hear`` -> media_id, seg_index, pos, start, end, text on the recording's time line; none of a failed window."""
    at = F.col("start_ms") / F.lit(1000.0)
    rows = heard.select("media_id", "seg_index", at.alias("at"), F.posexplode("segments").alias("pos", "s"))
    return rows.select("media_id", "seg_index", "pos", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"), F.col("s.text").alias("text"))


def transcribe(windows: DataFrame, make: Callable[[], Transcriber]) -> DataFrame:
    """media_id, seg_index, start_ms, end_ms -> media_id, seg_index, pos, start, end, text. A window whose call fails gives no rows."""
    return on_timeline(hear(windows, make))


PART = "media_id long, part int, seconds_ms long, segments array<struct<start:double,end:double,text:string>>, error string"


def hear_parts(parts: DataFrame, make: Callable[[], PartTranscriber]) -> DataFrame:
    """media_id, part, part_start, part_seconds (null for a whole file of unknown length) -> media_id, part, seconds_ms (the
    part's duration as the service measured it, else as planned), segments (null if the call failed), error."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = make()

        def one(m: int, part: int, start: float, seconds: float) -> tuple[list[dict] | None, int | None, str | None]:
            planned = None if pd.isna(seconds) else float(seconds)
            try:
                got, own = t.part(m, part, start, planned)
                own = planned if own is None else own
                return [{"start": float(x["start"]), "end": float(x["end"]), "text": x["text"]} for x in got], None if own is None else int(own * 1000), None
            except Exception as e:  # noqa: BLE001
                return None, None if planned is None else int(planned * 1000), _said(e)

        for p in batches:
            rows = [one(*r) for r in p[["media_id", "part", "part_start", "part_seconds"]].itertuples(index=False)]
            yield p[["media_id", "part"]].assign(seconds_ms=pd.array([r[1] for r in rows], dtype="Int64"), segments=[r[0] for r in rows], error=[r[2] for r in rows])

    ship(parts.sparkSession)
    return parts.select("media_id", F.col("part").cast("int").alias("part"), "part_start", "part_seconds").mapInPandas(over, PART)


def parts_on_timeline(heard: DataFrame) -> DataFrame:
    """Rows of ``hear_parts`` -> media_id, seg_index (the part), pos, start, end, text: each part follows the summed durations of those before."""
    at = running_offset(heard.withColumn("_ms", F.coalesce("seconds_ms", F.lit(0).cast("bigint"))), "_ms", "part")
    rows = at.select("media_id", F.col("part").alias("seg_index"), (F.col("offset") / F.lit(1000.0)).alias("at"), F.posexplode("segments").alias("pos", "s"))
    return rows.select("media_id", "seg_index", "pos", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"), F.col("s.text").alias("text"))


__all__ = ["FakeTranslator", "PartTranscriber", "ServiceError", "Transcriber", "Translator", "ask_batches", "ask_singles", "complete_batches", "fail_if_all_failed", "hear", "hear_parts", "on_timeline", "parts_on_timeline", "transcribe", "translate", "translated"]
