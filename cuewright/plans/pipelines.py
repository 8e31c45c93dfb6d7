"""The whole ways: merge two subtitle files; transcribe, clean and translate recordings; a video to its two files."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_title
from ..model import SPEECH_RESPONSE
from ..operators.choose import needs_no_translation, pick_subtitle
from ..operators.dedup import filter_hallucinations, near_duplicate_starts
from ..operators.intervals import GOOGLE_MAX_MS, WHISPER_MAX_MS, equal_parts, overlapping_windows, split_long, speech_segments
from ..operators.merge import positional_merge
from ..operators.speech import onto_timeline, pack_words, timed_words, transcript_of, words_of
from ..progress import Progress, counted
from ..providers import PartTranscriber, Transcriber, Translator, fail_if_all_failed, hear, hear_parts, on_timeline, parts_on_timeline, transcribe, translated
from ..sources.media import AUDIO_EXTENSIONS, MediaTools, log_lines, silence_log
from ..sources.subtitles import output_names, read_subtitles, read_vtt, render_srt, write_srt
from ..tables import settle
from ..workers import ship


def renumbered(segments: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy(*order)
    return segments.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))


def merge_files(spark: SparkSession, original: str, translated: str, out: str | None = None, other: str | None = None) -> DataFrame:
    """Two subtitle files, one below and one on top, as one recording (media_id 0)."""
    one = lambda p: renumbered(read_subtitles(spark, p, other).withColumn("media_id", F.lit(0).cast("bigint")), "idx")
    merged = positional_merge(one(original), one(translated))
    if out:
        write_srt(merged, out)
    return merged


def recording_windows(media: DataFrame, speech: DataFrame | None, longest: int) -> DataFrame:
    """media_id, seg_index, start_ms, end_ms: detected speech (long stretches split), or windows over the whole recording where none was detected."""
    fixed = media.select("media_id", F.lit(0).cast("bigint").alias("start_ms"), (F.col("duration") * 1000).cast("bigint").alias("end_ms"))
    rows = overlapping_windows(fixed, longest)
    if speech is not None:
        found = split_long(speech, longest)
        rows = found.select("media_id", "w_start", "w_end").unionByName(rows.join(speech.select("media_id").distinct(), "media_id", "left_anti").select("media_id", "w_start", "w_end"))
    w = Window.partitionBy("media_id").orderBy("w_start", "w_end")
    return rows.select("media_id", (F.row_number().over(w) - 1).cast("int").alias("seg_index"), F.col("w_start").alias("start_ms"), F.col("w_end").alias("end_ms"))


def clean_transcript(found: DataFrame, progress: Progress | None = None, overlaps: bool = True) -> DataFrame:
    """Windows' rows (media_id, seg_index, pos, start, end, text) in order, without repeated or empty texts, and, where
    windows overlap, without near duplicates. Parts that only follow each other keep their order and all starts."""
    rows = counted(progress, "transcribed", found)
    order = ("start", "seg_index", "pos") if overlaps else ("seg_index", "pos")
    rows = renumbered(rows, *order).select("media_id", "idx", "start", "end", "text")
    if overlaps:
        rows = renumbered(counted(progress, "without near duplicates", near_duplicate_starts(rows)), "idx")
    return renumbered(counted(progress, "without repeated texts", filter_hallucinations(rows)), "idx")


def spoken_lines(responses: DataFrame) -> DataFrame:
    """media_id, seg_index, start_ms, end_ms, response (model.SPEECH_RESPONSE) -> media_id, seg_index, pos, start, end, text.

    Words are packed into lines; a window whose answer has no words gives its whole transcript as one line, if there is any.
    """
    at = F.col("start_ms") / F.lit(1000.0)
    spans = responses.select("media_id", "seg_index", "start_ms", "end_ms")
    packed = pack_words(timed_words(responses)).join(spans, ["media_id", "seg_index"])
    lines = onto_timeline(packed, at, repair=True).select("media_id", "seg_index", F.col("line").alias("pos"), "start", "end", "text")
    bare = responses.where(F.coalesce(F.size(words_of(F.col("response"))), F.lit(0)) <= 0).withColumn("text", transcript_of(F.col("response"))).where("text <> ''")
    whole = bare.select("media_id", "seg_index", F.lit(0).alias("pos"), at.alias("start"), (F.col("end_ms") / F.lit(1000.0)).alias("end"), "text")
    return lines.unionByName(whole)


def ask_speech(windows: DataFrame, make: Callable[[], object]) -> DataFrame:
    """media_id, seg_index, start_ms, end_ms, response (what ``make().response(media_id, start_ms, end_ms)`` gives as JSON; {} if the call failed), error."""

    def over(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = make()

        def one(m: int, s: int, e: int) -> tuple[str, str | None]:
            try:
                return service.response(m, s, e), None
            except Exception as err:  # noqa: BLE001
                return "{}", f"{type(err).__name__}: {err}"[:500]

        for p in parts:
            rows = [one(*r) for r in p[["media_id", "start_ms", "end_ms"]].itertuples(index=False)]
            yield p.assign(json=[r[0] for r in rows], error=[r[1] for r in rows])

    ship(windows.sparkSession)
    asked = windows.select("media_id", "seg_index", "start_ms", "end_ms").mapInPandas(over, "media_id long, seg_index int, start_ms long, end_ms long, json string, error string")
    return asked.select("media_id", "seg_index", "start_ms", "end_ms", F.from_json("json", SPEECH_RESPONSE).alias("response"), "error")


def planned(media: DataFrame, speech: DataFrame | None, longest: int | None, engine: str) -> tuple[DataFrame, DataFrame]:
    """(windows, parts) of recordings (media_id, duration, and size in bytes if some are to be parted).

    Where detected speech is given, recordings with some go by it; else, with a longest window (the word service always
    has one), those of known duration go by overlapping windows. All others go whole or, beyond the size limit, in equal
    parts: windows have media_id, seg_index, start_ms, end_ms; parts media_id, part, n_parts, part_start, part_seconds.
    """
    most = GOOGLE_MAX_MS if engine == "google" else longest or WHISPER_MAX_MS
    timed = media.where("duration > 0")
    if speech is not None:
        windows = recording_windows(timed.limit(0), speech.join(media.select("media_id"), "media_id", "left_semi"), most)
        rest = media.join(speech.select("media_id").distinct(), "media_id", "left_anti")
    elif longest is not None or engine == "google":
        windows = recording_windows(timed, None, most)
        rest = media.where("duration is null or duration <= 0")
    else:
        windows, rest = recording_windows(timed.limit(0), None, most), media
    size = F.coalesce("size", F.lit(0)) if "size" in media.columns else F.lit(0)
    parts = equal_parts(rest.select("media_id", "duration", size.cast("bigint").alias("size")))
    return windows, parts.select("media_id", F.col("part").cast("int").alias("part"), "n_parts", "part_start", "part_seconds")


def transcript(media: DataFrame, make: Callable[[], object], engine: str = "whisper", speech: DataFrame | None = None, longest: int | None = None, calls: int = 5, parts: Callable[[], PartTranscriber] | None = None, progress: Progress | None = None) -> DataFrame:
    """media_id, idx, start, end, text of recordings (media_id, duration, size), ``calls`` at a time; each call is made once.

    "google" takes windows of up to 59 s and answers in words; any other engine name takes segments. What ``planned``
    sends whole or in parts goes to ``parts`` (by default what ``make`` gives, if it can), whatever the engine.
    Raises ``ServiceError`` if every call failed; else a failed call gives no rows, and ``calls_of`` tells why.
    """
    asked, in_parts = calls_of(media, make, engine, speech, longest, calls, parts)
    said = spoken_lines(asked) if engine == "google" else on_timeline(asked)
    windowed, whole = clean_transcript(said, progress), clean_transcript(parts_on_timeline(in_parts), overlaps=False)
    return counted(progress, "lines", windowed.unionByName(whole))


def calls_of(media: DataFrame, make: Callable[[], object], engine: str = "whisper", speech: DataFrame | None = None, longest: int | None = None, calls: int = 5, parts: Callable[[], PartTranscriber] | None = None) -> tuple[DataFrame, DataFrame]:
    """The answers for windows (as ``hear`` or ``ask_speech``) and for parts (``hear_parts``), each with ``error``; settled."""
    windows, rest = planned(media, speech, longest, engine)
    lost = F.col("part_seconds").isNull() & (F.col("n_parts") > 1)  # too large to send whole, and no telling where to cut

    spread = windows.repartition(calls, "media_id", "seg_index")
    asked = settle(ask_speech(spread, make) if engine == "google" else hear(spread, make), "heard-windows")
    heard = hear_parts(rest.where(~lost).repartition(calls, "media_id", "part"), parts or make)
    cannot = rest.where(lost & (F.col("part") == 0)).select("media_id", "part", F.lit(None).cast("bigint").alias("seconds_ms"), F.lit(None).cast(heard.schema["segments"].dataType).alias("segments"), F.lit("the duration is unknown").alias("error"))
    in_parts = settle(heard.unionByName(cannot), "heard-parts")
    fail_if_all_failed(asked.select("error").unionByName(in_parts.select("error")))
    return asked, in_parts


def in_subtitles(segments: DataFrame, target: str, code: str | None, make: Callable[[], Translator], pause: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(translated, bilingual). Subtitles that are in the target language already are not translated; others are asked
    for once, and ``ServiceError`` is raised if no answer came for any of them."""
    skip = code is not None and segments.sparkSession.range(1).select(needs_no_translation(F.lit(code), F.lit(target))).first()[0]
    if skip:
        return segments, positional_merge(segments, segments)
    done = settle(translated(segments, make, pause=pause), "translated")
    fail_if_all_failed(done.select(F.when(F.col("source") == "original", F.coalesce("error", F.lit("no answer"))).alias("error")))
    done = done.select("media_id", "idx", "start", "end", "text")
    return done, positional_merge(segments, done)


def subtitles(windows: DataFrame, speech: Callable[[], Transcriber], translator: Callable[[], Translator] | None, pause: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(transcript, bilingual). Without a translator (the target is the language spoken) both are the transcript. All
    calls are made here, once, however often the two are read."""
    text = settle(clean_transcript(transcribe(windows, speech)), "transcript")
    if translator is None:
        return text, text
    return text, in_subtitles(text, "", None, translator, pause)[1]


def one_file(segments: DataFrame, path: str) -> str:
    """One recording's segments as one SRT file of the driver."""
    rows = render_srt(segments).collect()
    with open(path, "w", encoding="utf-8") as f:
        f.write(rows[0].content if rows else "")
    return path


def detected_speech(files: DataFrame, tools: Callable[[], MediaTools]) -> DataFrame:
    """media_id, path -> media_id, seg_index, start_ms, end_ms of what the silence detector leaves."""
    silences, durations = silence_log(settle(log_lines(files, tools), "silence-logs"))
    return speech_segments(silences.select("media_id", "pos", "s_start", "s_end"), durations)


def process_video(
    spark: SparkSession, url: str, downloader: object, translator: Callable[[], Translator], speech: Callable[[str], Callable[[], object]], tools: Callable[[], MediaTools],
    target: str = "Simplified Chinese", out: str = "output", force_audio: bool = False, engine: str = "whisper", use_vad: bool = False, longest: int | None = None,
    parts: Callable[[str], Callable[[], PartTranscriber]] | None = None, progress: Progress | None = None, percent: Callable[[str], None] | None = None, pause: float = 1.0,
) -> tuple[str, str] | None:
    """A video to its translated and its bilingual file (their paths), or None if it can't be had; ``progress`` says why.

    Uploaded subtitles are taken if there are any (unless ``force_audio``), else the sound, if need be downloaded.
    ``speech`` and ``parts`` give the service's factory for a sound file. Files go below ``out``.
    """
    say = progress.say if progress else lambda _: None
    folder = {k: os.path.join(out, k) for k in ("original", "translated")}
    for path in folder.values():
        os.makedirs(path, exist_ok=True)
    say(f"video {url} to {target}")
    info = downloader.info(url)
    if not info:
        say("error: no information on the video")
        return None
    one = spark.range(1)
    title = one.select(file_title(F.lit(info.get("title", "video")))).first()[0]
    base = os.path.join(folder["original"], title)
    codes = [] if force_audio else list(info.get("subtitles") or {})
    if codes:
        listed = spark.createDataFrame([(0, i, c) for i, c in enumerate(codes)], "media_id long, pos int, code string")
        code = pick_subtitle(listed, F.lit(target)).first().code
        say(f"subtitles in {code}")
        file = downloader.subtitle(url, code, base, percent) or f"{base}.{code}.vtt"
        if not os.path.exists(file):
            say("error: the subtitles did not arrive")
            return None
        original = settle(renumbered(read_vtt(spark, f"file://{os.path.abspath(file)}").withColumn("media_id", F.lit(0).cast("bigint")), "idx"), "original")
    else:
        code = None
        sound = next((f for f in (f"{base}_audio{e}" for e in AUDIO_EXTENSIONS) if os.path.exists(f) and os.path.getsize(f) > 0), None)
        say(f"sound is there: {os.path.basename(sound)}" if sound else "downloading the sound")
        sound = sound or downloader.audio(url, f"{base}_audio", percent)
        if not sound:
            say("error: the sound did not arrive")
            return None
        tool = tools()
        media = spark.createDataFrame([(0, sound, tool.duration(sound), os.path.getsize(sound))], "media_id long, path string, duration double, size long")
        found = detected_speech(media.select("media_id", "path"), tools) if use_vad else None
        say(f"transcribing ({engine})")
        try:
            original = settle(transcript(media, speech(sound), engine, found, longest, parts=parts(sound) if parts else None, progress=progress), "original")
        except Exception as e:  # whatever a service or tool does, the caller gets a message  # noqa: BLE001
            say(f"error: no transcript: {e}")
            return None
    say(f"{original.count()} lines")
    try:
        done, both = in_subtitles(original, target, code, translator, pause)
    except Exception as e:  # noqa: BLE001
        say(f"error: no translation: {e}")
        return None
    names = one.select(*output_names(F.lit(title), F.lit(target))).first()
    paths = tuple(one_file(x, os.path.join(folder["translated"], n)) for x, n in zip((done, both), names, strict=True))
    say(f"done: {', '.join(paths)}")
    return paths


__all__ = ["ask_speech", "calls_of", "clean_transcript", "detected_speech", "in_subtitles", "merge_files", "one_file", "planned", "process_video", "recording_windows", "renumbered", "spoken_lines", "subtitles", "transcript"]
