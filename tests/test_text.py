import pytest
from pyspark.sql import functions as F

from cuewright.functions import text as fn


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("seconds", "stamp"), [(3661.5, "01:01:01,500"), (0.0, "00:00:00,000"), (2.3, "00:00:02,299"), (2.9999, "00:00:02,999"), (360000.25, "100:00:00,250")])
def test_format_timestamp_cuts(spark, seconds, stamp):
    assert one(spark, seconds, fn.format_timestamp, "double") == stamp


@pytest.mark.parametrize(("t", "s"), [("00:01:02.5", 62.5), ("01:02.25", 62.25), ("5", 0.0), ("1:2:3:4", 0.0), ("", 0.0), ("x:10", None), ("1:2.5:3", None), ("00:00:4.0d", None), ("00:00:.5", 0.5), ("100:00:00.0", 360000.0)])
def test_clock_seconds(spark, t, s):
    assert one(spark, t, fn.clock_seconds) == s


def test_srt_seconds(spark):
    assert one(spark, "00:00:01,250", fn.srt_seconds) == 1.25


def test_strip_takes_all_white_space_but_no_marks(spark):
    odd = "\t 　\x1c  x y \n"
    assert one(spark, odd, fn.strip) == odd.strip() == "x y"
    assert one(spark, "﻿x​", fn.strip) == "﻿x​"
    assert one(spark, odd, fn.rstrip) == odd.rstrip()


@pytest.mark.parametrize(("line", "s"), [("  Duration: 01:02:03.50, start", 3723.5), ("Duration: N/A", 0.0), ("Duration: 00:00:05", 0.0)])
def test_log_duration(spark, line, s):
    assert one(spark, line, fn.log_duration) == s


def test_titles_and_names(spark):
    assert one(spark, "A/b: C-3 ünï²! ", fn.file_title) == "Ab C3 ünï²"


@pytest.mark.parametrize(("raw", "text", "value"), [("\x1b[0;94m 12.5%\x1b[0m", "12.5%", 12.5), (" N/A%", None, None), ("", None, None), ("x%", "x%", None)])
def test_percent(spark, raw, text, value):
    assert one(spark, raw, fn.clean_percent) == text
    assert one(spark, raw, lambda c: fn.percent_value(fn.clean_percent(c))) == value


@pytest.mark.parametrize(("raw", "s"), [("1.500s", 1.5), ("", 0.0), (None, 0.0), ("soon", None)])
def test_duration_text(spark, raw, s):
    assert one(spark, raw, fn.duration_text) == s


def test_small_ones(spark):
    assert one(spark, "ja", fn.speech_code) == "ja-JP"
    assert one(spark, "xx", fn.speech_code) == "en-US"
    assert one(spark, None, fn.speech_code) == "en-US"
    assert one(spark, "", lambda c: fn.first_set(c, F.lit("b"))) == "b"
    assert one(spark, 1.9999, fn.to_ms, "double") == 1999
    assert one(spark, "zh-Hans", lambda c: fn.mentions(c, F.lit("ZH"))) is True
    assert one(spark, 1048576 * 3, fn.megabytes, "long") == 3.0
    assert one(spark, 5.0, lambda c: fn.not_empty_interval(c, F.lit(5.0)), "double") == 7.0
    assert one(spark, "abcdef", lambda c: fn.preview(c, 3)) == "abc..."
