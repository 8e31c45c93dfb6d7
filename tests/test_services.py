import json
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from cuewright.__main__ import main
from cuewright.plans import pipelines
from cuewright.sources import media, services


class Handler(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        Handler.seen.append((self.path, self.headers.get("Authorization"), body))
        if self.path.startswith("/speech"):
            status, out = (200, {"results": []}) if b"FLAC" in body else (400, {})
        elif self.path == "/none" or self.path.startswith("/none?"):
            status, out = 403, {}
        elif self.path == "/whisper":
            status, out = 200, {"segments": [{"start": 0, "end": 1.5, "text": "hi", "id": 7}]}
        else:
            asked = json.loads(body)
            text = asked["messages"][1]["content"]
            if "response_format" in asked:
                items = json.loads(text)["segments_to_translate"]
                out = {"segments": [dict(s, text=s["text"].upper()) for s in items if s["id"] != 1]}
                text = json.dumps(out)
            else:
                text = f" one {text} "
            status, out = 200, {"choices": [{"message": {"content": text}}]}
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


class NoCut(services.FfmpegTools):
    def cut(self, path, start_ms, end_ms, out):
        if path == "bad":
            return False
        with open(out, "wb") as f:
            f.write(b"audio")
        return True

    def duration(self, path):
        return None if path == "bad" else 12.5 if path.endswith(".mp3") else 6.1

    def silence_lines(self, path):
        return [] if path == "bad" else ["  Duration: 00:00:12.50, start: 0.0", "[silencedetect] silence_start: 4", "[silencedetect] silence_end: 6 | silence_duration: 2"]


def test_chat(url):
    t = services.ChatTranslator("k", "French", "m", url + "/chat")
    got = json.loads(t.batch('{"segments_to_translate":[{"id":0,"text":"a"},{"id":1,"text":"b"}]}'))
    assert [s["text"] for s in got["segments"]] == ["A"]
    assert t.single("x").strip() == "one x"
    assert Handler.seen[-1][1] == "Bearer k" and b"French" in Handler.seen[-1][2]
    assert "key=" not in repr(t)


def test_speech_services(url):
    w = services.WhisperTranscriber("k", str, "en", None, url + "/whisper", NoCut())
    assert w.window(1, 0, 1000) == [{"start": 0, "end": 1.5, "text": "hi"}]
    assert b'name="language"\r\n\r\nen' in Handler.seen[-1][2] and b'name="prompt"' not in Handler.seen[-1][2]
    with pytest.raises(RuntimeError, match="cut"):
        services.WhisperTranscriber("k", lambda _: "bad", tools=NoCut()).window(1, 0, 1)
    g = services.GoogleSpeech("k", str, "ja", url + "/speech", NoCut())
    assert json.loads(g.response(1, 0, 1)) == {"results": []}
    assert b'"languageCode": "ja-JP"' in Handler.seen[-1][2]
    with pytest.raises(RuntimeError, match="cut"):
        services.GoogleSpeech("k", lambda _: "bad", tools=NoCut()).response(1, 0, 1)
    with pytest.raises(urllib.error.HTTPError):
        services.GoogleSpeech("k", str, "ja", url + "/none", NoCut()).response(1, 0, 1)


def test_parts_of_a_file(url, tmp_path):
    file = tmp_path / "talk.mp3"
    file.write_bytes(b"whole")
    w = services.WhisperTranscriber("k", lambda _: str(file), "en", "names", url + "/whisper", NoCut())
    said = [{"start": 0, "end": 1.5, "text": "hi"}]
    assert w.part(1, 0, 0.0, None) == (said, 12.5) and b"whole" in Handler.seen[-1][2] and b'name="prompt"\r\n\r\nnames' in Handler.seen[-1][2]
    assert w.part(1, 0, 0.0, 12.5) == (said, 12.5) and b"whole" in Handler.seen[-1][2]
    assert w.part(1, 1, 6.0, 6.0) == (said, 6.1) and b"audio" in Handler.seen[-1][2]


def test_tools_over_tables(spark, tmp_path):
    files = spark.createDataFrame([(0, "talk.mp3"), (1, "bad")], "media_id long, path string")
    assert [r.duration for r in media.with_duration(files, NoCut).orderBy("media_id").collect()] == [12.5, None]
    logs = media.log_lines(files, NoCut)
    assert [(r.pos, r.line) for r in logs.where("media_id = 0").orderBy("pos").collect()][:1] == [(0, "  Duration: 00:00:12.50, start: 0.0")]
    found = pipelines.detected_speech(files.where("media_id = 0"), NoCut)
    assert [(r.start_ms, r.end_ms) for r in found.orderBy("seg_index").collect()] == [(0, 4200), (5800, 12500)]
    cuts = spark.createDataFrame([(0, "talk.mp3", 0, 10, str(tmp_path / "a")), (1, "bad", 0, 10, str(tmp_path / "b"))], "media_id long, path string, start_ms long, end_ms long, out string")
    assert [r.done for r in media.cut_files(cuts, NoCut).orderBy("media_id").collect()] == [True, False]
    assert (tmp_path / "a").read_bytes() == b"audio"


def test_programs_that_are_missing(tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", str(tmp_path))
    assert services.FfmpegTools().duration("x") is None
    assert services.FfmpegTools().cut("x", 0, 1, "y") is False


@pytest.mark.parametrize("key", [None, "", "  ", "your-key-here", "sk-..."])
def test_placeholder_keys(key):
    with pytest.raises(ValueError, match="key"):
        services.safe_key(key)


def test_commands(spark, tmp_path, url, monkeypatch):
    (tmp_path / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n00:00:01,000 --> 00:00:02,000\nb\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nB\n")
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    at = lambda n: str(tmp_path / n)
    assert main(["merge", at("a.srt"), at("b.vtt"), at("m.srt")], spark) == 0
    assert (tmp_path / "m.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,000\nB\na\n\n2\n00:00:01,000 --> 00:00:02,000\nb\n\n"
    assert main(["convert", at("b.vtt"), at("c.srt")], spark) == 0
    assert main(["translate", at("a.srt"), at("t"), "--language", "French", "--url", url + "/chat"], spark) == 0
    assert (tmp_path / "t.French.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,000\nA\n\n2\n00:00:01,000 --> 00:00:02,000\none b\n\n"
    assert (tmp_path / "t.French.bilingual.srt").read_text().startswith("1\n00:00:00,000 --> 00:00:01,000\nA\na\n")
    with pytest.raises(SystemExit):
        main(["merge", at("none"), at("b.vtt"), at("x")], spark)


class Videos:
    """A downloader without a network."""

    def __init__(self, codes=(), lost=False):
        self.codes, self.lost, self.asked = codes, lost, []

    def info(self, url):
        return None if url == "gone" else {"title": "A talk: 1/2 ", "subtitles": dict.fromkeys(self.codes)}

    def subtitle(self, url, language, out, percent=None):
        self.asked.append(language)
        if self.lost:
            return None
        with open(f"{out}.{language}.vtt", "w") as f:
            f.write("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nfirst\n\n00:00:02.000 --> 00:00:03.000\nsecond\n")
        return f"{out}.{language}.vtt"

    def audio(self, url, out, percent=None):
        self.asked.append("audio")
        if self.lost:
            return None
        if percent:
            percent("100%")
        with open(f"{out}.mp3", "wb") as f:
            f.write(b"sound")
        return f"{out}.mp3"


def test_video_to_files(spark, tmp_path, url, monkeypatch, capsys):
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    monkeypatch.delenv("GOOGLE_API_KEY", raising=False)
    urls = ["--url-chat", url + "/chat", "--url-whisper", url + "/whisper", "--url-speech", url + "/speech", "--config", str(tmp_path / "none.json")]
    run = lambda d, name, *more: main(["video", "v", "--out", str(tmp_path / name), *more, *urls], spark, d, NoCut)
    read = lambda name, kind="": (tmp_path / name / "translated" / f"A talk 12.{kind}srt").read_text()

    # Uploaded subtitles, the best of those there are, translated.
    d = Videos(("fr", "ja", "en"))
    assert run(d, "a", "--lang", "German") == 0 and d.asked == ["en"]
    assert read("a", "German.").startswith("1\n00:00:01,000 --> 00:00:02,000\nFIRST\n\n2\n")
    assert read("a", "German.bilingual.").startswith("1\n00:00:01,000 --> 00:00:02,000\nFIRST\nfirst\n")
    assert (tmp_path / "a" / "original" / "A talk 12.en.vtt").exists()
    # In the target language already: as they are.
    assert run(Videos(("fr", "zh-CN")), "b") == 0
    assert read("b", "Simplified Chinese.").startswith("1\n00:00:01,000 --> 00:00:02,000\nfirst\n")
    assert read("b", "Simplified Chinese.bilingual.").startswith("1\n00:00:01,000 --> 00:00:02,000\nfirst\nfirst\n")
    # No subtitles, or not wanted: the sound, whole; it is downloaded once.
    d = Videos(("fr",))
    assert run(d, "c", "--lang", "German", "--force-audio", "--source-lang", "th", "--whisper-prompt", "hello") == 0
    assert run(d, "c", "--lang", "German", "--force-audio") == 0 and d.asked == ["audio"]
    assert read("c", "German.") == "1\n00:00:00,000 --> 00:00:01,500\nHI\n\n"
    sent = [body for path, _, body in Handler.seen if path == "/whisper" and b"sound" in body]
    assert len(sent) == 2 and b"\r\n\r\nth\r\n" in sent[0] and b"\r\n\r\nhello\r\n" in sent[0]
    # By windows, and by detected speech.
    pieces = lambda: sum(path == "/whisper" and b"audio" in body for path, _, body in Handler.seen)
    for name, more, n in (("d", ("--max-segment-sec", "20"), 1), ("e", ("--use-vad",), 2)):
        before = pieces()
        assert run(Videos(), name, "--lang", "German", *more) == 0 and pieces() == before + n
        assert read(name, "German.") == "1\n00:00:00,000 --> 00:00:01,500\nHI\n\n"
    # What can't be had is said.
    assert run(Videos(("fr",), lost=True), "f") == 1 and run(Videos(lost=True), "g") == 1
    assert main(["video", "gone", "--out", str(tmp_path / "h"), *urls], spark, Videos(), NoCut) == 1
    assert main(["video", "v", "--out", str(tmp_path / "i"), "--force-audio", *urls[:2], "--url-whisper", url + "/none"], spark, Videos(), NoCut) == 1
    said = capsys.readouterr().out
    assert all(x in said for x in ("subtitles in en", "100%", "no information", "subtitles did not arrive", "sound did not arrive", "403", "done: "))
    with pytest.raises(ValueError, match="google"):
        run(Videos(), "j", "--engine", "google")
