"""Services over HTTP and programs on the path, behind the interfaces of ``providers`` and ``media``.

Only the standard library is used. Instances travel to tasks, so they hold settings and open connections per call.
Nothing here runs unless a caller names an endpoint, a key or a media file.
"""

from __future__ import annotations

import base64
import json
import os
import re
import subprocess
import tempfile
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.text import SPEECH_CODES
from ..progress import percent_hook

CHAT_URL = "https://api.openai.com/v1/chat/completions"
WHISPER_URL = "https://api.openai.com/v1/audio/transcriptions"
SPEECH_URL = "https://speech.googleapis.com/v1/speech:recognize"
BATCH_TIMEOUT, SINGLE_TIMEOUT = 60, 30

#: Ours; the answer's shape is what ``operators.batching.answers`` reads.
BATCH_PROMPT = (
    "You translate subtitles into {language}. You get JSON with segments_to_translate and perhaps "
    "previous_context_for_reference_only, which is there to read and not to translate. Answer with one JSON object whose "
    "only key, segments, lists every segment with its id, start and end as given and its text translated. Leave none out, "
    "merge none, and keep meaning and tone."
)
SINGLE_PROMPT = "Translate this subtitle into {language}, keeping meaning and tone. Answer with the translation and nothing else."


def post_json(url: str, body: dict, headers: dict[str, str], timeout: float | None) -> dict:
    data = json.dumps(body, ensure_ascii=False).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers})  # noqa: S310
    with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
        return json.loads(r.read())


@dataclass
class ChatTranslator:
    """A chat model that answers in JSON; ``providers.Translator``."""

    key: str = field(repr=False)
    language: str
    model: str
    url: str = CHAT_URL

    def _ask(self, prompt: str, text: str, timeout: float, **more) -> str:
        messages = [{"role": "system", "content": prompt.format(language=self.language)}, {"role": "user", "content": text}]
        got = post_json(self.url, {"model": self.model, "messages": messages, **more}, {"Authorization": f"Bearer {self.key}"}, timeout)
        return got["choices"][0]["message"]["content"]

    def batch(self, request: str) -> str:
        return self._ask(BATCH_PROMPT, request, BATCH_TIMEOUT, response_format={"type": "json_object"})

    def single(self, text: str) -> str | None:
        return self._ask(SINGLE_PROMPT, text, SINGLE_TIMEOUT)


class FfmpegTools:
    """Cuts and measures media by the usual programs, which must be on the path of every executor."""

    def _run(self, *cmd: str) -> subprocess.CompletedProcess:
        return subprocess.run(cmd, capture_output=True, check=True)  # noqa: S603

    def duration(self, path: str) -> float | None:
        try:
            out = self._run("ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "default=noprint_wrappers=1:nokey=1", path)
            return float(out.stdout)
        except (OSError, subprocess.CalledProcessError, ValueError):
            return None

    def cut(self, path: str, start_ms: int, end_ms: int, out: str) -> bool:
        """AAC, or 16 kHz mono FLAC if ``out`` ends in .flac."""
        codec = ["flac", "-ar", "16000", "-ac", "1"] if out.endswith(".flac") else ["aac"]
        try:
            self._run("ffmpeg", "-y", "-ss", str(start_ms / 1000.0), "-t", str((end_ms - start_ms) / 1000.0), "-i", path, "-acodec", *codec, out)
        except (OSError, subprocess.CalledProcessError):
            return False
        return True

    def silence_lines(self, path: str, least_ms: int = 1000, level_db: int = -40) -> list[str]:
        """The silence detector's log, for ``media.silence_log``; its exit status says nothing."""
        cmd = ("ffmpeg", "-i", path, "-af", f"silencedetect=noise={level_db}dB:d={least_ms / 1000.0}", "-f", "null", "-")
        return subprocess.run(cmd, capture_output=True, check=False).stderr.decode("utf-8", "replace").splitlines()  # noqa: S603


@dataclass
class WhisperTranscriber:
    """Segments of a window; ``providers.Transcriber``. ``path_of`` gives the media file of a media_id."""

    key: str = field(repr=False)
    path_of: Callable[[int], str]
    language: str | None = None
    prompt: str | None = None
    url: str = WHISPER_URL
    tools: FfmpegTools = field(default_factory=FfmpegTools)

    def window(self, media_id: int, start_ms: int, end_ms: int) -> list[dict]:
        with tempfile.TemporaryDirectory() as d:
            piece = os.path.join(d, "part.m4a")
            if not self.tools.cut(self.path_of(media_id), start_ms, end_ms, piece):
                raise RuntimeError("the window could not be cut")
            return self._ask(piece)

    def part(self, media_id: int, part: int, start: float, seconds: float | None) -> tuple[list[dict], float | None]:
        """``providers.PartTranscriber``: the file itself if it is one part that starts at 0 and lasts as long as the file."""
        path = self.path_of(media_id)
        whole = self.tools.duration(path)
        if seconds is None or (part == 0 and whole is not None and seconds >= whole):
            return self._ask(path), whole
        with tempfile.TemporaryDirectory() as d:
            piece = os.path.join(d, "part.m4a")
            if not self.tools.cut(path, int(start * 1000), int((start + seconds) * 1000), piece):
                raise RuntimeError("the part could not be cut")
            return self._ask(piece), self.tools.duration(piece)

    def _ask(self, path: str) -> list[dict]:
        with open(path, "rb") as f:
            audio = f.read()
        fields = {"model": "whisper-1", "response_format": "verbose_json", "timestamp_granularities[]": "segment", "language": self.language, "prompt": self.prompt}
        edge = uuid.uuid4().hex
        body = b"".join(f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items() if v)
        body += f'--{edge}\r\nContent-Disposition: form-data; name="file"; filename="part.m4a"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + audio + f"\r\n--{edge}--\r\n".encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": f"multipart/form-data; boundary={edge}", "Authorization": f"Bearer {self.key}"})  # noqa: S310
        with urllib.request.urlopen(request) as r:  # noqa: S310
            return [{k: s[k] for k in ("start", "end", "text")} for s in json.loads(r.read()).get("segments", [])]


@dataclass
class GoogleSpeech:
    """The service's JSON for a window of up to 59 s, to be read with ``model.SPEECH_RESPONSE``; raises where it answers with an error."""

    key: str = field(repr=False)
    path_of: Callable[[int], str]
    language: str | None = None
    url: str = SPEECH_URL
    tools: FfmpegTools = field(default_factory=FfmpegTools)

    def response(self, media_id: int, start_ms: int, end_ms: int) -> str:
        with tempfile.TemporaryDirectory() as d:
            part = os.path.join(d, "part.flac")
            if not self.tools.cut(self.path_of(media_id), start_ms, end_ms, part):
                raise RuntimeError("the window could not be cut")
            with open(part, "rb") as f:
                content = base64.b64encode(f.read()).decode()
        config = {"encoding": "FLAC", "sampleRateHertz": 16000, "languageCode": SPEECH_CODES.get(self.language or "", "en-US"), "enableAutomaticPunctuation": True, "enableWordTimeOffsets": True, "model": "default"}
        return json.dumps(post_json(f"{self.url}?key={self.key}", {"config": config, "audio": {"content": content}}, {}, None))


class Downloader:
    """Titles, subtitles and audio of videos by the yt_dlp module, where it is installed."""

    def _ydl(self, **options):
        try:
            import yt_dlp
        except ImportError as e:
            raise RuntimeError("yt_dlp is not installed") from e
        return yt_dlp.YoutubeDL({"quiet": True, "no_warnings": True, **options})

    def info(self, url: str) -> dict | None:
        """Title and subtitles of a video, or None where there is no telling."""
        with self._ydl(skip_download=True) as y:
            try:
                return y.extract_info(url, download=False)
            except Exception:  # the module's errors are many; without an answer there is no video  # noqa: BLE001
                return None

    def _get(self, url: str, percent: Callable[[str], None] | None, **options) -> bool:
        if percent:
            options["progress_hooks"] = [percent_hook(percent)]
        with self._ydl(**options) as y:
            try:
                y.download([url])
            except Exception:  # noqa: BLE001
                return False
        return True

    def subtitle(self, url: str, language: str, out: str, percent: Callable[[str], None] | None = None) -> str | None:
        path = f"{out}.{language}.vtt"
        got = self._get(url, percent, writesubtitles=True, skip_download=True, subtitleslangs=[language], outtmpl=out)
        return path if got and os.path.exists(path) else None

    def audio(self, url: str, out: str, percent: Callable[[str], None] | None = None) -> str | None:
        mp3 = {"key": "FFmpegExtractAudio", "preferredcodec": "mp3", "preferredquality": "192"}
        got = self._get(url, percent, format="bestaudio/best", outtmpl=out, postprocessors=[mp3])
        return f"{out}.mp3" if got and os.path.exists(f"{out}.mp3") else None


def safe_key(key: str | None) -> str:
    """The key, or an error if there is none or only a placeholder."""
    if not key or re.fullmatch(r"(?i)\s*(your[-_ ].*|sk-\.\.\.)?\s*", key):
        raise ValueError("no API key is set")
    return key
