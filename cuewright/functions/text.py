"""Column functions on text and clock notations. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a text (Unicode white space and the information separators).
WHITE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space at both ends; ``trim`` knows the blank only."""
    return F.regexp_replace(col(c), f"^[{WHITE}]+|[{WHITE}]+\\z", "")


def rstrip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), f"[{WHITE}]+\\z", "")


def one_line_ends(c: str | Column) -> Column:
    """CR LF and CR as LF."""
    return F.regexp_replace(col(c), "\r\n?", "\n")


def whole_number(c: Column) -> Column:
    """A long, or null for what is not plain digits with a sign; white space around is allowed."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))


def decimal_number(c: Column) -> Column:
    """A double, or null; unlike a plain cast it takes no type suffix."""
    s = strip(c)
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def format_timestamp(seconds: str | Column) -> Column:
    """HH:MM:SS,mmm; milliseconds are cut, not rounded; hours may have more than two digits."""
    s = col(seconds).cast("double")
    whole = s.cast("bigint")
    ms = ((s - whole) * 1000).cast("int")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600).cast("bigint"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("bigint"), F.pmod(whole, F.lit(60)), ms)


def clock_seconds(c: str | Column) -> Column:
    """h:m:s or m:s as seconds. Any other number of parts is 0; a part that is no number gives null."""
    p = F.split(col(c), ":")
    part = lambda i: F.get(p, F.lit(i))
    three = whole_number(part(0)) * 3600 + whole_number(part(1)) * 60 + decimal_number(part(2))
    two = whole_number(part(0)) * 60 + decimal_number(part(1))
    return F.when(F.size(p) == 3, three).when(F.size(p) == 2, two).otherwise(F.lit(0.0)).cast("double")


def srt_seconds(c: str | Column) -> Column:
    """As ``clock_seconds``, with a comma for the point."""
    return clock_seconds(F.replace(col(c), F.lit(","), F.lit(".")))


def log_duration(c: str | Column) -> Column:
    """Seconds from a media tool's ``Duration: HH:MM:SS.ff``; 0 if there is none."""
    rx = r"Duration: (\d+):(\d+):(\d+\.\d+)"
    part = lambda i: F.regexp_extract(col(c), rx, i).try_cast("double")
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0.0))


def file_title(c: str | Column) -> Column:
    """Letters, digits and blanks only, without trailing white space."""
    return rstrip(F.regexp_replace(col(c), r"[^\p{L}\p{Nd}\u00B2\u00B3\u00B9\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468 ]", ""))


def clean_percent(c: str | Column) -> Column:
    """A progress text without colour codes; null if nothing or N/A remains."""
    s = strip(F.regexp_replace(col(c), "\x1b[^m]*m", ""))
    return F.when((s != "") & (s != "N/A%"), s)


def percent_value(c: str | Column) -> Column:
    """The number before a percent sign; null if it is none."""
    return decimal_number(F.btrim(col(c), F.lit("%")))


def duration_text(c: str | Column) -> Column:
    """``1.500s`` as 1.5; missing or empty is 0; anything else that is no number is null."""
    s = F.coalesce(col(c), F.lit(""))
    return F.when(F.rtrim(s, F.lit("s")) == "", F.lit(0.0)).otherwise(decimal_number(F.rtrim(s, F.lit("s"))))


#: Codes that the speech service takes for each short language code.
SPEECH_CODES = {"th": "th-TH", "en": "en-US", "ja": "ja-JP", "zh": "zh-CN"}


def speech_code(c: str | Column) -> Column:
    out = F.lit("en-US")
    for short, code in SPEECH_CODES.items():
        out = F.when(col(c) == short, F.lit(code)).otherwise(out)
    return out


def first_set(*cs: str | Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs])


def preview(c: str | Column, n: int) -> Column:
    return F.concat(F.substring(col(c), 1, n), F.lit("..."))


def mentions(text: str | Column, part: str | Column) -> Column:
    return F.contains(F.lower(col(text)), F.lower(col(part)))


def to_ms(seconds: str | Column) -> Column:
    return (col(seconds) * 1000).cast("bigint")


def to_seconds(ms: str | Column) -> Column:
    return col(ms) / F.lit(1000.0)


def megabytes(size: str | Column) -> Column:
    return col(size) / F.lit(1024.0 * 1024.0)


def not_empty_interval(start: str | Column, end: str | Column, at_least: float = 2.0) -> Column:
    """The end, or ``at_least`` seconds after the start where it is not after it."""
    return F.when(col(end) <= col(start), col(start) + F.lit(at_least)).otherwise(col(end))
