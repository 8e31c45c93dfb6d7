"""python -m cuewright video URL, merge ORIGINAL TRANSLATED OUT, translate IN OUT --language L, convert IN OUT."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.merge import positional_merge
from .plans.pipelines import merge_files, one_file, process_video, renumbered
from .progress import Progress
from .providers import translate
from .sources.media import first_setting, load_config
from .sources.services import CHAT_URL, SPEECH_URL, WHISPER_URL, ChatTranslator, Downloader, FfmpegTools, GoogleSpeech, WhisperTranscriber, safe_key
from .sources.subtitles import read_subtitles
from .tables import settle


def video(a: argparse.Namespace, spark: SparkSession, downloader: object | None = None, tools=FfmpegTools) -> int:
    """Settings come from the command line, then the environment, then the file, then a default."""
    config = load_config(a.config)
    key = safe_key(first_setting(os.environ.get("OPENAI_API_KEY"), config.get("openai_api_key")))
    target = first_setting(a.lang, os.environ.get("DEFAULT_TARGET_LANGUAGE"), config.get("default_target_language"), default="Simplified Chinese")
    model = first_setting(a.model, os.environ.get("OPENAI_MODEL"), config.get("model"), default="gpt-4o")
    google = first_setting(os.environ.get("GOOGLE_API_KEY"), config.get("google_api_key"), config.get("Google API Key"))
    if a.engine == "google" and not google:
        raise ValueError("the google engine needs an API key of its own")
    language, prompt, chat, whisper_url, speech_url = a.source_lang, a.whisper_prompt, a.url_chat, a.url_whisper, a.url_speech

    def whisper(path: str):
        return lambda: WhisperTranscriber(key, lambda _: path, language, prompt, whisper_url, tools())

    def words(path: str):
        return lambda: GoogleSpeech(google, lambda _: path, language, speech_url, tools())

    longest = a.max_segment_sec * 1000 if a.max_segment_sec else None
    done = process_video(
        spark, a.url, downloader or Downloader(), lambda: ChatTranslator(key, target, model, chat), words if a.engine == "google" else whisper, tools,
        target, a.out, a.force_audio, a.engine, a.use_vad, longest, whisper, Progress(print), print,
    )
    return 0 if done else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None, downloader: object | None = None, tools=FfmpegTools) -> int:
    p = argparse.ArgumentParser(prog="cuewright")
    sub = p.add_subparsers(dest="what", required=True)
    m = sub.add_parser("merge", help="one file below, one on top")
    m.add_argument("original")
    m.add_argument("translated")
    m.add_argument("out")
    t = sub.add_parser("translate", help="a file to a translated and a bilingual one")
    t.add_argument("source")
    t.add_argument("out", help="without extension: OUT.LANGUAGE.srt and OUT.LANGUAGE.bilingual.srt are written")
    t.add_argument("--language")
    t.add_argument("--model")
    t.add_argument("--config", default="config.json")
    t.add_argument("--url", default=CHAT_URL)
    c = sub.add_parser("convert", help="WebVTT or SRT to SRT")
    c.add_argument("source")
    c.add_argument("out")
    v = sub.add_parser("video", help="a video to a translated and a bilingual file")
    v.add_argument("url")
    v.add_argument("--lang", help="target language")
    v.add_argument("--model")
    v.add_argument("--force-audio", action="store_true", help="transcribe though there are subtitles")
    v.add_argument("--source-lang", help="code of the language spoken")
    v.add_argument("--use-vad", action="store_true", help="cut by detected silence")
    v.add_argument("--whisper-prompt")
    v.add_argument("--max-segment-sec", type=int)
    v.add_argument("--engine", default="whisper", help="whisper or google")
    v.add_argument("--out", default="output")
    v.add_argument("--config", default="config.json")
    v.add_argument("--url-chat", default=CHAT_URL)
    v.add_argument("--url-whisper", default=WHISPER_URL)
    v.add_argument("--url-speech", default=SPEECH_URL)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("cuewright").getOrCreate()
    if a.what == "video":
        return video(a, spark, downloader, tools)
    if a.what == "merge":
        for f in (a.original, a.translated):
            if not os.path.exists(f):
                p.error(f"no such file: {f}")
        out = merge_files(spark, a.original, a.translated)
        if not out.limit(1).count():
            p.error("neither file has a cue")
        one_file(out, a.out)
        return 0
    source = renumbered(read_subtitles(spark, a.source).withColumn("media_id", F.lit(0).cast("bigint")), "idx")
    if a.what == "convert":
        one_file(source, a.out)
        return 0
    config = load_config(a.config)
    language = first_setting(a.language, os.environ.get("DEFAULT_TARGET_LANGUAGE"), config.get("default_target_language"), default="Simplified Chinese")
    model = first_setting(a.model, os.environ.get("OPENAI_MODEL"), config.get("model"), default="gpt-4o")
    key = safe_key(first_setting(os.environ.get("OPENAI_API_KEY"), config.get("openai_api_key")))
    url = a.url
    done = settle(translate(source, lambda: ChatTranslator(key, language, model, url)), "translated")  # asked once for both files
    one_file(done, f"{a.out}.{language}.srt")
    one_file(positional_merge(source, done), f"{a.out}.{language}.bilingual.srt")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
