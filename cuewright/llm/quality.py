"""Quality rules: a threshold table that becomes one projection of built-in expressions.

Every measure is an expression over one row, so the operator is a single narrow stage: no shuffle, no Python, nothing
kept between rows; a task's memory is that of its longest text. A null or empty text has no words: all measures are 0
and the base rule (at least ``MIN_WORDS`` words) rejects it. Ties, repeated rows and null ids change nothing, as each
row is judged alone; an empty table stays empty. Extra columns pass through; one named like a measure or verdict is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, restored, slim, text_of, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "have", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "ce", "dans", "des", "du", "elle", "est", "et", "il", "je", "la", "le", "les", "ne", "pas", "pour", "que", "qui", "se", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "es", "ich", "im", "ist", "mit", "nicht", "sich", "sie", "und", "von", "zu",
    "con", "de", "del", "el", "en", "las", "los", "más", "no", "para", "por", "su", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` or the document goes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Bounds in the range that published web-corpus filters use; dup_lines is looser, as line dedup follows and one line of three is soon repeated.
RULES = (
    Rule("length", "n_words", MIN_WORDS, None),
    Rule("repeats", "repeat_percent", None, MAX_REPEAT_PERCENT),
    Rule("word_length", "mean_word_length", 2.5, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("dup_lines", "dup_line_ratio", None, 0.5),
    Rule("alphabetic", "alpha_word_ratio", 0.7, None),
)


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that the text has at least twice.

    Hashes only say where to look: windows of equal hash are compared word by word. Flagged window starts, sorted,
    cover 3 words each less what the next one covers too.
    """

    def flagged(w: Column, s: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & (F.get(w, a["i"]) == F.get(w, b["i"])) & (F.get(w, a["i"] + 1) == F.get(w, b["i"] + 1)) & (F.get(w, a["i"] + 2) == F.get(w, b["i"] + 2))
        return F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def of(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.size(w) - 2)
        hashes = F.transform(starts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        at = lambda h: let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: flagged(w, s))
        count = lambda h: let(F.sort_array(F.transform(at(h), lambda x: x["i"])), covered)
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), count(h)).otherwise(F.lit(0).cast("bigint")))
        return F.when(F.size(w) >= 4, some).otherwise(F.lit(0).cast("bigint"))

    return let(w, of)


def measures(text: Column) -> dict[str, Column]:
    """Name -> expression over the text; later ones refer to ``_w``, its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.greatest(F.size("_w"), F.lit(1))
    drop = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    return {
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("bigint"),
        "n_symbols": drop(r"[#*$%&|<>]+").cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated_words(F.col("_w")),
        "_n_lines": F.size(lines),
        "stop_ratio": F.size(F.filter("_w", lambda x: x.isin(*STOP_WORDS, *map(str.capitalize, STOP_WORDS)))) / n,
        "alpha_word_ratio": F.size(F.filter("_w", lambda x: x.rlike(r"\p{L}"))) / n,
    }


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_length": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "repeat_percent": 100 * F.col("n_repeat_words") / n,
    }


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The table as one boolean expression: the names of the rules that fail, comma-joined; '' is a pass."""
    fails = []
    for r in rules:
        c = F.col(r.measure)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (c < r.low)
        if r.high is not None:
            bad = bad | (c > r.high)
        fails.append(F.when(bad, F.lit(r.name)))
    return F.concat_ws(",", *fails)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every measure, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    m = measures(text_of())
    out = slim(docs).withColumn("_w", words(text_of())).withColumns(m).withColumns(ratios())
    out = out.withColumns({"base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")), "failed_rules": verdict(rules)})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
    return restored(out, docs.columns, extra=(*(c for c in m if c != "_n_lines"), *ratios(), "base_failed", "failed_rules", "kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    all_ = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    judged = quality_rules(all_, rules).select("_row", "kept")
    # A generator, as a filter would go below the projection and take the text apart once for each measure.
    return judged.select(F.explode(F.filter(F.array("_row"), lambda _: F.col("kept"))).alias("_row")).select("_row.*")
