"""Subtitle files built from known cues, and texts, at random: what comes back is what went in."""

import random

from pyspark.sql import functions as F

from cuewright.functions import text as fn
from cuewright.sources import subtitles as sub


def stamp(ms, mark, short=False):
    clock = f"{ms // 60_000 % 60:02}:{ms // 1000 % 60:02}{mark}{ms % 1000:03}"
    return clock if short and ms < 3_600_000 else f"{ms // 3_600_000:02}:{clock}"


def cues(r):
    out, at = [], 0
    for _ in range(r.randint(0, 25)):
        at += r.randint(0, 900_000)
        until = at + r.randint(0, 9_999)
        out.append((at, until, [" ".join(r.choice(["so", "it", "goes", "7", "été", "日本"]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 3))]))
    return out


def expected(kept):
    return [(s / 1000, e / 1000, "\n".join(lines)) for s, e, lines in kept]


def vtt_file(r):
    """(content, cues that a reader must find)"""
    blocks, kept = [r.choice(["WEBVTT", "WEBVTT ", "NOTE no header"])], []
    for s, e, lines in cues(r):
        kind = r.random()
        times = f"{stamp(s, '.', r.random() < 0.5)} --> {stamp(e, '.', r.random() < 0.5)}"
        if kind < 0.1:
            blocks.append(r.choice(["NOTE one", "NOTES2\nmore", "NOTE"]) + "\n" + times + "\n" + lines[0])
        elif kind < 0.2:
            blocks.append("\n".join(lines))  # no time
        elif kind < 0.3:
            blocks.append(r.choice(["aa:00 --> 00:01", times.replace(" --> ", "-->"), times + " --> 00:09", times.replace(".", "x")]) + "\n" + lines[0])
        else:
            empty = r.random() < 0.1
            head = r.choice(["", "", "12\n", "a name\n", " \n"])
            blocks.append(head + times + r.choice(["", "", " align:start line:0", " "]) + "".join(f"\n{x}" for x in ([] if empty else lines)))
            kept.append((s, e, [] if empty else lines))
    return "\n\n".join(blocks), expected(kept)


def srt_file(r):
    content, kept = "", []
    for n, (s, e, lines) in enumerate(cues(r), 1):
        kind = r.random()
        times = f"{stamp(s, ',')} --> {stamp(e, ',')}"
        if kind < 0.1:
            content += f"{n}\n{times}"  # no text
        elif kind < 0.2:
            content += f"{n}\nno time\n{lines[0]}"
        elif kind < 0.3:
            content += f"{n}\n" + r.choice([times.replace(",", ",x"), times + " foo", "--> " + times, "oh:no --> 00:01"]) + f"\n{lines[0]}"
        else:
            wide = r.random() < 0.2
            content += f"{n}\n" + (times.replace("> ", ">  ") if wide else times) + "\n" + "\n".join(lines)
            kept.append((s, e, lines))
        content += "\n" * r.randint(2, 4)
    return content, expected(kept)


def with_ends(r, content):
    return r.choice(["", "\n", " \n\n"]) * (not content.startswith("WEBVTT ")) + content.replace("\n", r.choice(["\n", "\r\n", "\r"]))


def rows(df):
    out = {}
    for r in df.orderBy("media_id", "idx").collect():
        out.setdefault(r.media_id, []).append((round(r.start, 6), round(r.end, 6), r.text))
    return out


def test_cues_come_back(spark):
    r = random.Random(11)
    for make, parse in ((vtt_file, sub.parse_vtt), (srt_file, lambda f: sub.parse_srt(f, "permissive"))):
        files = [make(r) for _ in range(200)]
        df = spark.createDataFrame([(i, with_ends(r, c)) for i, (c, _) in enumerate(files)], "media_id long, content string")
        assert rows(parse(df)) == {i: want for i, (_, want) in enumerate(files) if want}


def test_strip_against_python(spark):
    r = random.Random(12)
    chars = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0x180E)] + list("ab")
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 8))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", fn.strip("t").alias("s"), fn.rstrip("t").alias("r"))
    assert {x.i: (x.s, x.r) for x in df.collect()} == {i: (t.strip(), t.rstrip()) for i, t in enumerate(texts)}


def test_stamps_of_whole_milliseconds(spark):
    """Cut, never rounded: a stamp is at most a millisecond behind, and whole seconds are exact."""
    r = random.Random(13)
    values = [r.choice([r.random() * 10, r.random() * 5000, r.random() * 10**6, float(r.randint(0, 10**5))]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, s double").select("i", fn.format_timestamp("s").alias("t"), fn.srt_seconds(fn.format_timestamp(F.col("s"))).alias("back"))
    for x in df.collect():
        assert 0 <= values[x.i] - x.back < 0.0011
        assert x.t == stamp(round(x.back * 1000), ",") and (values[x.i] % 1 or x.t.endswith(",000"))
