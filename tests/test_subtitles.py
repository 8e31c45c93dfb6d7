import pytest
from pyspark.sql import functions as F

from cuewright.plans.pipelines import merge_files
from cuewright.sources import subtitles as sub


def files(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "media_id long, content string")


def rows(df):
    return [tuple(r) for r in df.orderBy("media_id", "idx").select("media_id", "idx", "start", "end", "text").collect()]


VTT = "WEBVTT\n\n00:00:00.250 --> 00:00:01.750\nthe lake\nis frozen\n\n00:00:03.500 --> 00:01:04.125 size:80% line:2\nwalk slowly\n"


def test_vtt(spark):
    assert rows(sub.parse_vtt(files(spark, VTT))) == [(0, 0, 0.25, 1.75, "the lake\nis frozen"), (0, 1, 3.5, 64.125, "walk slowly")]
    assert rows(sub.parse_vtt(files(spark, VTT.replace("\n", "\r\n")))) == rows(sub.parse_vtt(files(spark, VTT)))


def test_vtt_traps(spark):
    glued = "WEBVTT\n00:00:00.000 --> 00:00:01.000\nlost\n\n00:00:01.000 --> 00:00:02.000\nkept"
    bom = "﻿WEBVTT\n00:00:00.000 --> 00:00:01.000\nkept by its mark"
    notes = "WEBVTT\n\nNOTES1\n00:00:00.000 --> 00:00:01.000\nlost\n\n1\n00:00:01.000 --> 00:00:02.000\n\n\n00:00:03.000 --> x\nbad\n\n00:00:04.000 --> 00:00:05.000\tline:0\ntab"
    odd = "WEBVTT\n\n00:00:01.000 -->  00:00:02.000\nempty end\n\n00:00:01.000-->00:00:02.000\nno blanks\n\n 00:00:09.0 --> 100:00:00.000\nlong\n \n00:00:10.0 --> 00:00:11.0\nsame block"
    got = rows(sub.parse_vtt(files(spark, glued, bom, notes, odd)))
    assert got == [
        (0, 0, 1.0, 2.0, "kept"), (1, 0, 0.0, 1.0, "kept by its mark"),
        (2, 0, 1.0, 2.0, ""), (2, 1, 3.0, 0.0, "bad"), (2, 2, 4.0, 0.0, "tab"),  # one part is 0 s, no error
        
        (3, 0, 1.0, 0.0, "empty end"), (3, 1, 9.0, 360000.0, "long\n \n00:00:10.0 --> 00:00:11.0\nsame block"),
    ]


SRT = "1\n00:00:00,250 --> 00:00:01,750\nle lac\n\n2\n00:00:03,500 --> 00:01:04,125\nva\nlentement \n\n\n3\n00:00:05,000 --> 00:00:06,000\n\n4\nno time\nx"


def test_srt(spark):
    assert rows(sub.parse_srt(files(spark, SRT))) == [(0, 0, 0.25, 1.75, "le lac"), (0, 1, 3.5, 64.125, "va\nlentement")]


def test_srt_modes(spark):
    bad = "1\n00:00:00,000 --> oh:no\nx\n\n2\n00:00:01,000 --> 00:00:02,000\ny"
    two = files(spark, bad, SRT)
    for use in (lambda d: d.collect(), lambda d: d.select("text").collect(), lambda d: d.count(), lambda d: d.select("media_id").distinct().count()):
        with pytest.raises(Exception, match="malformed time line"):
            use(sub.parse_srt(two))
    assert [r[0] for r in rows(sub.parse_srt(two, "quarantine"))] == [1, 1]
    assert rows(sub.parse_srt(two, "permissive"))[0] == (0, 0, 1.0, 2.0, "y")
    with pytest.raises(ValueError, match="mode"):
        sub.parse_srt(two, "other")


def test_srt_ends(spark):
    """Blanks around the end are nothing, other parts make it no clock (0 s), and words make it malformed."""
    lines = ["00:00:01,000 -->  00:00:02,000", "00:00:01,000 --> 00:00:02,000 X1:10 X2:20", "00:00:01,000 --> 00:00:02,000 foo", "00:00:01,000 --> 00:00:02,000 "]
    got = rows(sub.parse_srt(files(spark, *(f"1\n{x}\nt" for x in lines)), "permissive"))
    assert [(r[0], r[3]) for r in got] == [(0, 2.0), (1, 0.0), (3, 2.0)]


def test_vtt_block_starts(spark):
    cue = "NOTE\n00:00:01.000 --> 00:00:02.000\nt"
    got = rows(sub.parse_vtt(files(spark, f"WEBVTT\n\n{cue}", f"WEBVTT\n\n\n{cue}", f"WEBVTT\n\n {cue}")))
    assert [r[0] for r in got] == [1, 2]


def test_render(spark):
    seg = spark.createDataFrame([(0, 5, 62.5, 4000.0, " after "), (0, 1, 0.0, 2.125, "before"), (1, 0, 0.0, 1.0, None)], "media_id long, idx long, start double, end double, text string")
    got = {r[0]: r[1] for r in sub.render_srt(seg).collect()}
    assert got == {0: "1\n00:00:00,000 --> 00:00:02,125\nbefore\n\n2\n00:01:02,500 --> 01:06:40,000\nafter\n\n", 1: "1\n00:00:00,000 --> 00:00:01,000\n\n\n"}


def test_files(spark, tmp_path):
    (tmp_path / "a.vtt").write_text(VTT)
    (tmp_path / "b.srt").write_text(SRT)
    (tmp_path / "c.sub").write_text(SRT)
    assert sub.read_vtt(spark, str(tmp_path / "a.vtt")).count() == 2
    assert sub.read_srt(spark, str(tmp_path / "b.srt")).count() == 2
    assert sub.read_srt(spark, str(tmp_path / "none.srt")).count() == 0
    assert sub.read_subtitles(spark, str(tmp_path / "*")).count() == 4
    assert sub.read_subtitles(spark, str(tmp_path / "*"), other="srt").count() == 6
    (tmp_path / "d.VTT").write_text(SRT)  # the case of the extension counts
    assert sub.read_subtitles(spark, str(tmp_path / "*")).count() == 4


def test_merge_files(spark, tmp_path):
    (tmp_path / "a.vtt").write_text(VTT + "\n00:00:09.000 --> 00:00:10.000\nonly below\n")
    (tmp_path / "b.srt").write_text(SRT)
    out = merge_files(spark, str(tmp_path / "a.vtt"), str(tmp_path / "b.srt"), out=f"file://{tmp_path}/out")
    assert rows(out) == [(0, 0, 0.25, 1.75, "le lac\nthe lake\nis frozen"), (0, 1, 3.5, 64.125, "va\nlentement\nwalk slowly"), (0, 2, 9.0, 10.0, "only below")]
    written = "".join(p.read_text() for p in (tmp_path / "out").rglob("part-*.txt"))
    assert written == sub.render_srt(out).first().content
    again = sub.parse_srt(spark.createDataFrame([(0, written)], "media_id long, content string"))
    assert rows(again) == rows(out)


def test_names(spark):
    a, b = sub.output_names(F.lit("T"), F.lit("French"))
    assert tuple(spark.range(1).select(a, b).first()) == ("T.French.srt", "T.French.bilingual.srt")
