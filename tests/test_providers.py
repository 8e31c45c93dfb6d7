import json

import pytest

from cuewright.plans.pipelines import calls_of, in_subtitles, planned, recording_windows, subtitles, transcript
from cuewright.progress import Progress, percent_hook
from cuewright.providers import FakeTranslator, ServiceError, ask_batches, hear, transcribe, translate, translated

SEG = "media_id long, idx long, start double, end double, text string"


class Whole:
    def batch(self, request):
        return json.dumps({"segments": [dict(s, text="T:" + s["text"], start=0, end=0) for s in json.loads(request)["segments_to_translate"]]})

    def single(self, text):
        raise AssertionError("no single text should be asked for")


class OnlyFirst(Whole):
    def batch(self, request):
        items = json.loads(request)["segments_to_translate"]
        return json.dumps({"segments": [dict(items[0], text="first")]})

    def single(self, text):
        return f" one:{text} "


class Broken(Whole):
    def batch(self, request):
        raise RuntimeError("down")

    def single(self, text):
        raise RuntimeError("down")


def run(spark, make, n=2, batch=15):
    df = spark.createDataFrame([(0, i, i * 2.0, i * 2 + 1.0, f"s{i}") for i in range(n)], SEG)
    return [(r.idx, r.start, r.text) for r in translate(df, make, batch, pause=0.0).orderBy("idx").collect()]


def test_whole_batches(spark):
    assert run(spark, Whole) == [(0, 0.0, "T:s0"), (1, 2.0, "T:s1")]


def test_partial_batch_falls_back(spark):
    assert run(spark, OnlyFirst, batch=2) == [(0, 0.0, "first"), (1, 2.0, "one:s1")]


def test_failure_keeps_the_original(spark):
    assert run(spark, Broken, 3) == [(0, 0.0, "s0"), (1, 2.0, "s1"), (2, 4.0, "s2")]


def test_fake(spark):
    got = dict((i, t) for i, _, t in run(spark, FakeTranslator, 20))
    assert got[0] == "[x] s0" and got[3] == "s3" and got[18] == "(s18)"


def test_retries_keep_the_last_answer(spark):
    class Flaky(Whole):
        n = 0

        def batch(self, request):
            Flaky.n += 1
            if Flaky.n == 2:
                raise RuntimeError
            return json.dumps({"segments": [{"id": Flaky.n, "text": "x"}]})

    asked = spark.createDataFrame([(0, 0, '{"segments_to_translate":[{"id":0},{"id":1}]}')], "media_id long, batch_no long, request string")
    got = ask_batches(asked, Flaky, pause=0.0).collect()[0]
    assert json.loads(got.response)["segments"][0]["id"] == 3 and got.attempts == 3 and got.error is None


class Hears:
    def window(self, media_id, start_ms, end_ms):
        if media_id == 9:
            raise RuntimeError("no audio")
        return [{"start": t - start_ms / 1000, "end": t - start_ms / 1000 + 1, "text": f"at {t}"} for t in range(start_ms // 1000, end_ms // 1000, 4)]


def test_recording_to_bilingual(spark):
    media = spark.createDataFrame([(0, 40.0), (9, 8.0)], "media_id long, duration double")
    windows = recording_windows(media, None, 15_000)
    assert transcribe(windows, Hears).where("media_id = 9").count() == 0
    heard = hear(windows, Hears).collect()
    assert {r.error for r in heard if r.media_id == 9} == {"RuntimeError: no audio"} and {r.error for r in heard if r.media_id == 0} == {None}
    text, both = subtitles(windows, Hears, Whole, pause=0.0)
    rows = [(r.start, r.text) for r in text.orderBy("idx").collect()]
    assert rows == sorted(rows) and len({t for t, _ in rows}) == len(rows)
    assert [r.text for r in both.orderBy("idx").collect()] == [f"T:{t}\n{t}" for _, t in rows]


def test_detected_speech_comes_first(spark):
    media = spark.createDataFrame([(0, 40.0), (1, 40.0)], "media_id long, duration double")
    speech = spark.createDataFrame([(0, 0, 1000, 9000)], "media_id long, seg_index int, start_ms long, end_ms long")
    got = [(r.media_id, r.start_ms, r.end_ms) for r in recording_windows(media, speech, 30_000).orderBy("media_id", "seg_index").collect()]
    assert got == [(0, 1000, 9000), (1, 0, 30000), (1, 20000, 40000)]


class Words:
    def response(self, media_id, start_ms, end_ms):
        if media_id == 9:
            raise RuntimeError("refused")
        if media_id == 2:
            return json.dumps({"results": [{"alternatives": [{"transcript": "only text"}]}, {"alternatives": [{"transcript": "and more "}]}]})
        words = [{"word": f"w{start_ms + i}", "startTime": f"{i}.500s", "endTime": f"{i}.500s" if i == 4 else f"{i + 1}s"} for i in range(5)]
        words[4]["word"] += "."
        return json.dumps({"results": [{"alternatives": [{"transcript": "x", "words": words}]}]})


def test_word_service(spark):
    media = spark.createDataFrame([(0, 8.0), (2, 70.0), (9, 8.0), (10, None)], "media_id long, duration double")
    got = [tuple(r) for r in transcript(media, Words, "google").orderBy("media_id", "idx").select("media_id", "start", "end", "text").collect()]
    assert got == [(0, 0.5, 4.5, "w0 w1 w2 w3 w4."), (2, 0.0, 59.0, "only text and more")]  # the second window's equal text is a run


def test_target_language_is_not_translated(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 1.0, "a")], SEG)
    same, both = in_subtitles(df, "Simplified Chinese", "zh", Broken)
    assert same is df and both.first().text == "a\na"
    assert in_subtitles(df, "French", "en", Whole, 0.0)[1].first().text == "T:a\na"


def test_where_a_translation_came_from(spark):
    df = spark.createDataFrame([(0, i, i * 2.0, i * 2 + 1.0, f"s{i}") for i in range(20)], SEG)
    got = {r.idx: (r.source, r.error) for r in translated(df, FakeTranslator, pause=0.0).collect()}
    assert got[0] == ("batch", None) and got[3] == ("original", None) and got[18] == ("single", None)
    assert {(r.source, r.error) for r in translated(df, Broken, pause=0.0).collect()} == {("original", "RuntimeError: down")}


def test_nothing_but_failures_is_an_error(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 1.0, "a")], SEG)
    with pytest.raises(ServiceError, match="down"):
        in_subtitles(df, "French", "en", Broken, 0.0)
    nine = spark.createDataFrame([(9, 8.0)], "media_id long, duration double")
    with pytest.raises(ServiceError, match="no audio"):
        transcript(nine, Hears, longest=15_000)
    none = spark.createDataFrame([], "media_id long, duration double")
    assert transcript(none, Hears).count() == 0


class Counts(Hears):
    """Writes a line for each call."""

    def __init__(self, path):
        self.path = path

    def note(self, what):
        with open(self.path, "a") as f:
            f.write(what + "\n")

    def window(self, media_id, start_ms, end_ms):
        self.note(f"w {start_ms}")
        return super().window(media_id, start_ms, end_ms)

    def part(self, media_id, part, start, seconds):
        self.note(f"p {media_id} {part}")
        if media_id == 4 and part == 1:
            raise RuntimeError("cut off")
        return [{"start": 0.5, "end": 1.5, "text": f"part {media_id}.{part}"}], 7.25 if media_id == 3 else None

    def batch(self, request):
        self.note("b")
        return Whole().batch(request)

    def single(self, text):
        raise AssertionError


def test_calls_are_made_once(spark, tmp_path):
    path = str(tmp_path / "calls")
    media = spark.createDataFrame([(0, 95.0)], "media_id long, duration double")
    windows = recording_windows(media, None, 15_000)
    n = windows.count()
    text, both = subtitles(windows, lambda: Counts(path), lambda: Counts(path), pause=0.0)
    for df in (text, both, both):
        df.write.format("noop").mode("overwrite").save()
    calls = open(path).read().split("\n")[:-1]
    assert sum(c[0] == "w" for c in calls) == n and sum(c == "b" for c in calls) == -(-text.count() // 15)


MB = 1024 * 1024
MEDIA = "media_id long, duration double, size long"


def test_three_paths(spark):
    media = spark.createDataFrame([(0, 40.0, MB), (1, 90.0, 50 * MB), (2, None, MB), (3, 0.0, 50 * MB)], MEDIA)
    speech = spark.createDataFrame([(0, 0, 1000, 9000)], "media_id long, seg_index int, start_ms long, end_ms long")
    shape = lambda pair: (sorted((r.media_id, r.start_ms, r.end_ms) for r in pair[0].collect()), sorted((r.media_id, r.part) for r in pair[1].collect()))
    assert shape(planned(media, None, None, "whisper")) == ([], [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (3, 1), (3, 2)])
    assert shape(planned(media.where("media_id < 3"), speech, None, "whisper")) == ([(0, 1000, 9000)], [(1, 0), (1, 1), (1, 2), (2, 0)])
    windows, parts = shape(planned(media.where("media_id in (0, 2)"), None, 30_000, "whisper"))
    assert windows == [(0, 0, 30_000), (0, 20_000, 40_000)] and parts == [(2, 0)]
    windows, parts = shape(planned(media.where("media_id in (0, 2)"), None, None, "google"))
    assert windows == [(0, 0, 40_000)] and parts == [(2, 0)]


def test_standard_path(spark, tmp_path):
    """Whole or in parts, in order, times behind the measured or planned durations before; near starts stay; failures have a reason."""
    path = str(tmp_path / "calls")
    media = spark.createDataFrame([(0, 40.0, MB), (3, 20.0, 50 * MB), (4, 30.0, 50 * MB), (5, None, MB), (6, None, 50 * MB)], MEDIA)
    progress = Progress()
    got = transcript(media, lambda: Counts(path), progress=progress)
    rows = sorted((r.media_id, r.idx, round(r.start, 3), r.text) for r in got.collect())
    assert rows == [(0, 0, 0.5, "part 0.0"), (3, 0, 0.5, "part 3.0"), (3, 1, 7.75, "part 3.1"), (3, 2, 15.0, "part 3.2"), (4, 0, 0.5, "part 4.0"), (4, 1, 20.5, "part 4.2"), (5, 0, 0.5, "part 5.0")]
    assert len(open(path).read().split()) == 3 * 8 and progress.counts()["lines"] == 7
    _, parts = calls_of(media, lambda: Counts(path))
    why = {(r.media_id, r.part): r.error for r in parts.collect() if r.error}
    assert why == {(4, 1): "RuntimeError: cut off", (6, 0): "the duration is unknown"}


def test_a_service_of_windows_has_no_parts(spark):
    media = spark.createDataFrame([(0, 8.0), (2, None)], "media_id long, duration double")
    windows, parts = calls_of(media, Hears, longest=10_000)
    assert windows.count() == 1 and "part" in parts.first().error


def test_percentages():
    said = []
    hook = percent_hook(said.append)
    for e in ({"status": "downloading", "_percent_str": "\x1b[0;94m  4.5%\x1b[0m"}, {"status": "downloading", "_percent_str": "N/A%"}, {"status": "downloading"}, {"status": "finished"}, {"status": "else"}):
        hook(e)
    assert said == ["4.5%", "100%"]
