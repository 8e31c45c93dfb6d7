"""The named queries of the timed-text engine and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import providers
from ..functions import text as fn
from ..model import REQUEST, SPEECH_RESPONSE
from ..operators import batching, choose, dedup, intervals, merge, speech
from ..providers import FakeTranslator
from ..sources import media as media_source
from ..sources import subtitles
from ..workers import ship
from . import adapters, pipelines, sql
from .adapters import table

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _queries[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _queries


def oracle_sql() -> dict[str, str]:
    return sql.ORACLE


@query
def q01_format_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", fn.format_timestamp(F.col("value") * 60).alias("stamp"))


@query
def q02_parse_ts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = q01_format_ts(spark, sf_dir)
    wrong = F.when(F.col("event_id") % 2 == 0, F.lit("1:2:3:4")).otherwise(F.concat(F.lit("a:"), "stamp"))
    short = F.substring("stamp", 4, 100)
    bad = F.when(F.col("event_id") % 2 == 0, fn.clock_seconds(wrong)).otherwise(fn.clock_seconds(F.lit("x:10")))
    return t.select("event_id", fn.srt_seconds("stamp").alias("srt_seconds"), fn.srt_seconds(short).alias("short_seconds"), bad.alias("wrong_seconds"))


@query
def q03_srt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.render_srt(adapters.conversation_segments(spark, sf_dir))


#: Two blanks behind the arrow; words behind the end; too few lines; no time; more empty lines than one between cues.
_SRT_ODD = "\n\n7\n00:00:01,000 -->  00:00:02,000\ntwo blanks\n\n\n\n8\n00:00:03,000 --> 00:00:04,000 X1:10 X2:20\nplaced\n\n9\n00:00:05,000 --> 00:00:06,000\n\n10\nno time\nx\n"
#: A note behind one empty line more is a cue; a tab before the settings hides the end.
_VTT_ODD = "\n\n\nNOTE as a cue\n00:01:00.000 --> 00:01:01.000\nkept\n\nNOTE\n00:02:00.000 --> 00:02:01.000\ngone\n\n 00:03:00.000 --> 00:03:01.000\tline:0\ntab"


def _srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered, with odd blocks behind; every other file with the line ends of another system."""
    content = F.concat("content", F.lit(_SRT_ODD))
    return q03_srt_render(spark, sf_dir).select("media_id", F.when(F.col("media_id") % 2 == 0, content).otherwise(F.replace(content, F.lit("\n"), F.lit("\r\n"))).alias("content"))


@query
def q04_srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.parse_srt(_srt_files(spark, sf_dir))


def _vtt_time(c: str) -> Column:
    return F.replace(fn.format_timestamp(c), F.lit(","), F.lit("."))


def _vtt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered with a note, settings, cues without a time or with a bad one, and odd blocks behind."""
    seg = adapters.conversation_segments(spark, sf_dir)
    kind = F.col("idx") % 7
    line = F.when(kind == 3, F.concat(_vtt_time("start"), F.lit(" --> x1:00"))).when(kind == 5, F.lit("no time here")).otherwise(F.concat(_vtt_time("start"), F.lit(" --> "), _vtt_time("end"), F.lit(" align:start position:0%")))
    cues = seg.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.concat(line, F.lit("\n"), "text").alias("block")))).alias("cues"))
    return cues.select("media_id", F.concat(F.lit("WEBVTT\n\nNOTE made here\n\n"), F.array_join(F.transform("cues", lambda x: x["block"]), "\n\n"), F.lit(_VTT_ODD)).alias("content"))


@query
def q05_vtt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.parse_vtt(_vtt_files(spark, sf_dir))


@query
def q06_bilingual_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = adapters.conversation_segments(spark, sf_dir)
    out = merge.merge_within(seg, top=F.col("role") == "assistant", bottom=F.col("role") == "user")
    return out.withColumn("start_stamp", fn.format_timestamp("start"))


@query
def q07_freq_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.drop_frequent(adapters.line_segments(spark, sf_dir)).select("media_id", "idx", "text")


@query
def q08_run_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.collapse_runs(adapters.line_segments(spark, sf_dir)).select("media_id", "idx", "text")


@query
def q09_filter_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.filter_hallucinations(adapters.line_segments(spark, sf_dir)).select("media_id", "idx", "text")


@query
def q10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicate_starts(adapters.event_segments(spark, sf_dir), 4 * 3600.0).select("media_id", "idx", "start", "text")


@query
def q11_gap_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.speech_segments(*adapters.silences(spark, sf_dir))


def _spans(spark: SparkSession, sf_dir: str, start: Column) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("media_id"), start.alias("start_ms"), (start + F.col("n_chars") * 100).alias("end_ms"))


@query
def q12_fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlapping_windows(_spans(spark, sf_dir, F.lit(0).cast("bigint")), 60_000).select("media_id", "w_start", "w_end")


@query
def q13_split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.split_long(_spans(spark, sf_dir, F.col("doc_id") * 1000), intervals.GOOGLE_MAX_MS).select("media_id", "w_start", "w_end")


@query
def q14_equal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), (F.col("n_chars") * 20_000).alias("size"), (F.col("n_chars") / F.lit(15.0)).alias("duration"))
    return intervals.equal_parts(files).select("media_id", "part", "n_parts", "part_start", "part_seconds")


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batches(adapters.line_segments(spark, sf_dir))


@query
def q15_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir).select("media_id", "idx", "batch_no", "local_id")


@query
def q16_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batch_context(_batched(spark, sf_dir))


@query
def q17_request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = batching.requests(_batched(spark, sf_dir))
    back = r.select("media_id", "batch_no", "request", F.from_json("request", REQUEST).alias("r"))
    seg = F.col("r.segments_to_translate")
    context = F.col("r.previous_context_for_reference_only")
    has = F.contains("request", F.lit('"previous_context_for_reference_only":'))
    return back.select("media_id", "batch_no", has.alias("has_context"), context.alias("context"), F.size(seg).alias("n_segments"), F.get(seg, F.size(seg) - 1)["id"].cast("bigint").alias("last_id"), F.get(seg, F.lit(0))["text"].alias("first_text"), F.get(seg, F.size(seg) - 1)["text"].alias("last_text"))


@query
def q18_realign_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers lack every fifth id and give another twice; a second question helps with half of the missing."""
    parts = _batched(spark, sf_dir)
    got = batching.answers(providers.ask_batches(batching.requests(parts), FakeTranslator, attempts=1))
    second = F.when(F.col("local_id") % 10 == 3, F.when(fn.strip("text") != "", F.concat(F.lit("("), "text", F.lit(")"))))
    return batching.realign(parts, got, second).select("media_id", "idx", "start", "end", "from_batch", "text")


@query
def q19_word_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = speech.pack_words(adapters.document_words(spark, sf_dir))
    return speech.onto_timeline(lines, F.lit(0.0), repair=True)


@query
def q20_offset_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("idx"), (F.length(F.coalesce("text", F.lit(""))) * 66).cast("bigint").alias("dur"))
    out = intervals.running_offset(c, "dur", "idx")
    return out.select("media_id", "idx", F.col("offset").alias("offset_ms"), (F.lit(0.5) + F.col("offset") / F.lit(1000.0)).alias("start"))


@query
def q21_pick_subtitle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    codes = d.groupBy(F.col("source").alias("media_id"), F.col("lang").alias("code")).agg(F.min("doc_id").alias("pos"))
    target = F.when(F.ascii(F.right("media_id", F.lit(1))) % 2 == 0, F.lit("de")).otherwise(F.lit("Simplified Chinese"))
    return choose.pick_subtitle(codes, target)


@query
def q22_sanitize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.file_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query
def q23_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.event_segments(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "event_type"), "idx")
    w = Window.partitionBy("media_id").orderBy("idx")
    n = (F.row_number().over(w) - 1).alias("n")
    starts = e.where("event_type = 'error'").select("media_id", n, F.col("start").alias("s"))
    ends = e.where("event_type = 'signup'").select("media_id", n, F.col("start").alias("e"))
    return media_source.positional_zip(starts, ends, adapters.silences(spark, sf_dir)[1])


@query
def q24_coalesce_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    env = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit("env"))
    file = F.when(k % 2 == 0, F.lit("file")).otherwise(F.lit(""))
    short = F.when(F.col("event_type") == "view", F.lit("th")).when(F.col("event_type") == "click", F.lit("ja")).when(F.col("event_type") == "signup", F.lit("zh")).when(F.col("event_type") == "error", F.lit("xx"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(fn.first_set(env, file), F.lit("default")).alias("setting"), F.coalesce(fn.speech_code(short), F.lit("en-US")).alias("code"))


@query
def q25_first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("m"), F.col("page_id") % 40)
    ext = F.get(F.array(*[F.lit(x) for x in (*media_source.AUDIO_EXTENSIONS, ".txt")]), (F.col("page_id") * 7 % 6).cast("int"))
    files = table(spark, sf_dir, "pages").select(F.concat(key, F.lit("/"), "page_id", ext).alias("path"), (F.col("page_id") % 3).alias("length"))
    return media_source.cached_audio(files, F.get(F.split("path", "/"), F.lit(0)))


@query
def q26_percent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    number = lambda n: F.concat((i % n).cast("string"), F.lit("."), (i % 10).cast("string"))
    kind = i % 5
    raw = F.when(kind == 2, F.lit(" x% ")).when(kind == 3, F.lit(" \x1b[0mN/A%")).when(kind == 4, F.lit("\x1b[0;94m  \x1b[0m")).otherwise(F.concat(F.lit("\x1b[0;94m "), number(101), F.lit("%\x1b[0m")))
    took = F.when(kind == 3, F.lit(None).cast("string")).when(kind == 4, F.lit("soon")).otherwise(F.concat(number(60), F.lit("s")))
    return table(spark, sf_dir, "events").select("event_id", fn.clean_percent(raw).alias("percent_text"), fn.percent_value(fn.clean_percent(raw)).alias("percent"), fn.duration_text(took).alias("duration"))


@query
def q27_asr_json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as a speech service's JSON, 20 a result, with a second alternative and an empty result, and back."""
    ms = lambda c: (F.col(c) * 1000 + 0.5).cast("bigint")
    clock = lambda c: F.format_string("%d.%03ds", F.floor(ms(c) / 1000).cast("bigint"), F.pmod(ms(c), F.lit(1000)))
    w = adapters.document_words(spark, sf_dir).select("media_id", "seg_index", "pos", F.struct("word", clock("start").alias("startTime"), clock("end").alias("endTime")).alias("w"))
    results = w.groupBy("media_id", "seg_index", F.floor(F.col("pos") / 20).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("words"))
    other = F.struct(F.lit("other").alias("transcript"), F.slice("words", F.lit(1), F.lit(1)).alias("words"))
    first = F.struct(F.lit("first").alias("transcript"), F.col("words"))
    body = results.groupBy("media_id", "seg_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", F.array(first, other).alias("alternatives")))), lambda x: F.struct(x["alternatives"].alias("alternatives"))).alias("results"))
    hollow = F.from_json(F.lit('[{"alternatives":[{"transcript":"no words"}]}]'), "array<struct<alternatives:array<struct<transcript:string,words:array<struct<word:string,startTime:string,endTime:string>>>>>>")
    texts = body.select("media_id", "seg_index", F.to_json(F.struct(F.concat("results", hollow).alias("results"))).alias("json"))
    return speech.timed_words(texts.select("media_id", "seg_index", F.from_json("json", SPEECH_RESPONSE).alias("response")))


class _TurnsHeard:
    """Hears the given turns (start and duration in ms, text) that begin in a window or part."""

    def __init__(self, turns: list):
        self.turns = turns

    def window(self, media_id: int, start_ms: int, end_ms: int) -> list[dict]:
        return [{"start": (x["s"] - start_ms) / 1000.0, "end": (x["s"] - start_ms + x["d"]) / 1000.0, "text": x["text"]} for x in self.turns if start_ms <= x["s"] < end_ms]

    def part(self, media_id: int, part: int, start: float, seconds: float) -> tuple[list[dict], float]:
        return [{"start": x["s"] / 1000.0 - start, "end": (x["s"] + x["d"]) / 1000.0 - start, "text": x["text"]} for x in self.turns if start * 1000 <= x["s"] < (start + seconds) * 1000], seconds


def with_turns(spans: DataFrame, turns: DataFrame, grid: int = 10_000) -> DataFrame:
    """``spans`` (media_id, lo, hi in ms, and more) with ``turns``: those that begin in it. Both sides meet by cells of the time line."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    cell = lambda c: F.floor(c / grid).cast("bigint")
    at = turns.select("media_id", ms("start").alias("s"), (ms("end") - ms("start")).alias("d"), "text").withColumn("cell", cell(F.col("s")))
    cells = spans.select("media_id", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    got = cells.join(at, ["media_id", "cell"]).where("s >= lo and s < hi").groupBy("media_id", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("s", "d", "text"))).alias("turns"))
    return spans.join(got, ["media_id", "lo", "hi"], "left").withColumn("turns", F.coalesce("turns", F.array().cast(got.schema["turns"].dataType)))


@query
def q28_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, a fake speech service, overlaps removed, texts filtered, translated, merged."""
    seg = adapters.conversation_segments(spark, sf_dir)
    recordings = seg.groupBy("media_id").agg((F.max(F.round(F.col("end") * 1000).cast("bigint")) / F.lit(1000.0)).alias("duration")).where("duration > 0")
    windows = pipelines.recording_windows(recordings, None, 20_000)
    spans = with_turns(windows.withColumns({"lo": F.col("start_ms").cast("double"), "hi": F.col("end_ms").cast("double")}), seg)

    def over(parts):
        for p in parts:
            heard = [_TurnsHeard(r.turns).window(r.media_id, r.start_ms, r.end_ms) for r in p.itertuples(index=False)]
            yield p[["media_id", "seg_index", "start_ms", "end_ms"]].assign(segments=heard, error=None)

    ship(spark)
    heard = spans.select("media_id", "seg_index", "start_ms", "end_ms", "turns").mapInPandas(over, providers.HEARD)
    text = pipelines.clean_transcript(providers.on_timeline(heard))
    return merge.positional_merge(text, providers.translate(text, FakeTranslator, pause=0.0))


@query
def q29_silence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's log lines made from events, parsed and zipped."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'view', 'click')")
    at = (F.col("event_id") % 100_000).cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("[silencedetect @ 0x1] silence_start: "), at, F.lit(".5"))).when(F.col("event_type") == "view", F.concat(F.lit("[silencedetect @ 0x1] silence_end: "), at, F.lit(".25 | silence_duration: 1"))).otherwise(F.lit("  Duration: 01:02:03.50, start: 0.0"))
    return media_source.silence_log(e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("pos"), line.alias("line")))[0]


@query
def q30_standard_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No windows: recordings whole or, by size, in equal parts; each part's times follow the durations of those before."""
    seg = adapters.conversation_segments(spark, sf_dir)
    length = F.max(F.round(F.col("end") * 1000).cast("bigint"))
    media = seg.groupBy("media_id").agg((length / F.lit(1000.0)).alias("duration"), (length * 4000).alias("size")).where("duration > 0")
    _, parts = pipelines.planned(media, None, None, "whisper")
    spans = with_turns(parts.withColumns({"lo": F.col("part_start") * 1000, "hi": (F.col("part_start") + F.col("part_seconds")) * 1000}), seg)

    def over(rows):
        for p in rows:
            heard = [_TurnsHeard(r.turns).part(r.media_id, r.part, r.part_start, r.part_seconds) for r in p.itertuples(index=False)]
            yield p[["media_id", "part"]].assign(seconds_ms=[int(h[1] * 1000) for h in heard], segments=[h[0] for h in heard], error=None)

    ship(spark)
    heard = spans.select("media_id", "part", "part_start", "part_seconds", "turns").mapInPandas(over, providers.PART)
    return pipelines.clean_transcript(providers.parts_on_timeline(heard), overlaps=False)


@query
def q31_no_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole filter with a likelihood of silence, which some rows lack."""
    k = F.col("idx") % 13
    seg = adapters.line_segments(spark, sf_dir).withColumn("no_speech", F.when(k < 12, k / F.lit(10.0)))
    return dedup.filter_hallucinations(seg, no_speech="no_speech").select("media_id", "idx", "text")


class _Flaky(FakeTranslator):
    """First gives every other text, then fails, then leaves out every fifth."""

    def __init__(self):
        self.asked: dict[str, int] = {}

    def batch(self, request: str) -> str:
        n = self.asked[request] = self.asked.get(request, 0) + 1
        if n == 2:
            raise RuntimeError("down")
        items = json.loads(request)["segments_to_translate"]
        return json.dumps({"segments": [s for s in items if (s["id"] % 2 == 0 if n == 1 else s["id"] % 5 != 3)]})


@query
def q32_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch is asked for again until as many ids come back as went out; the last answer that could be read counts."""
    parts = _batched(spark, sf_dir)
    keys = parts.groupBy("media_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct(F.col("local_id").alias("id"), "start", "end", "text"))).alias("segments_to_translate"))
    # The key is part of the request, so that the fake can tell batches with equal texts apart.
    asked = keys.select("media_id", "batch_no", F.to_json(F.struct("media_id", "batch_no", "segments_to_translate")).alias("request"))
    got = providers.ask_batches(asked, _Flaky, pause=0.0)
    answered = batching.answers(got)
    n = answered.groupBy("media_id", "batch_no").agg(F.count(F.lit(1)).alias("answered"))
    done = batching.complete_batches(parts, answered)
    return got.select("media_id", "batch_no", "attempts", "error").join(n, ["media_id", "batch_no"]).join(done, ["media_id", "batch_no"])


@query
def q33_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension: WebVTT, SRT, and others taken for SRT."""
    third = F.col("media_id") % 3
    named = lambda df, ext: df.withColumn("path", F.concat(F.lit("talks/"), F.col("media_id").cast("string"), ext))
    vtt = named(_vtt_files(spark, sf_dir).where(third == 0), F.lit(".vtt"))
    srt = named(_srt_files(spark, sf_dir).where(third != 0), F.when(third == 1, F.lit(".srt")).otherwise(F.lit(".VTT")))
    return subtitles.parse_by_name(vtt.unionByName(srt), other="srt")


@query
def q34_spoken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word service's answers on the time line: packed words, or the whole transcript where there are none."""
    seg = adapters.conversation_segments(spark, sf_dir)
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    word = lambda w, s, e: F.struct(w.alias("word"), F.lit(s).alias("startTime"), F.lit(e).cast("string").alias("endTime"))
    words = F.array(word(F.concat(F.lit("w"), F.col("idx").cast("string")), "0.500s", "1s"), word(F.lit("b."), "1s", None))
    alternative = lambda text, w=None: F.struct(text.cast("string").alias("transcript"), (F.lit(None) if w is None else w).cast("array<struct<word:string,startTime:string,endTime:string>>").alias("words"))
    result = lambda *a: F.struct((F.array(*a) if a else F.array().cast("array<struct<transcript:string,words:array<struct<word:string,startTime:string,endTime:string>>>>")).alias("alternatives"))
    bare = F.array(result(alternative(F.col("text"))), result(alternative(F.lit(None))), result(), result(alternative(F.lit("end")), alternative(F.lit("second"))))
    spoken = F.array(result(alternative(F.lit("not used"), words)))
    json_ = F.to_json(F.struct(F.when(F.col("idx") % 2 == 1, bare).otherwise(spoken).alias("results")))
    answers = seg.select("media_id", F.col("idx").cast("int").alias("seg_index"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), F.from_json(json_, SPEECH_RESPONSE).alias("response"))
    return pipelines.spoken_lines(answers)
