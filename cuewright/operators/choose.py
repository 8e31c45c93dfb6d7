"""Picking one of several by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mentions

#: Subtitle languages tried when none is the wanted one, and codes that count as Chinese.
PREFERRED = ("en", "en-US", "ja", "ko")
CHINESE_SEARCH = ("zh-Hans", "zh-CN", "zh-SG", "zh-Hans-CN")
CHINESE_CODES = (*CHINESE_SEARCH, "zh")


def _is_chinese(target: Column) -> Column:
    return F.contains(target, F.lit("Chinese"))


def wanted(code: Column, target: Column) -> Column:
    """Whether to look for this code: it mentions the target or, for Chinese, is one of the codes."""
    return (_is_chinese(target) & code.isin(*CHINESE_SEARCH)) | mentions(code, target)


def needs_no_translation(code: Column, target: Column) -> Column:
    return F.when(_is_chinese(target), code.isin(*CHINESE_CODES)).otherwise(mentions(code, target))


def pick_subtitle(codes: DataFrame, target: Column) -> DataFrame:
    """media_id, pos, code -> one row a media: first wanted code, else the first of ``PREFERRED`` there is, else the first; ``skip`` where it needs no translation."""
    rank = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(PREFERRED))):
        rank = F.when(F.col("code") == c, F.lit(i)).otherwise(rank)
    tier = F.when(wanted(F.col("code"), target), 0).when(rank.isNotNull(), 1).otherwise(2)
    within = F.when(tier == 1, rank).otherwise(F.lit(0))
    w = Window.partitionBy("media_id").orderBy("tier", "within", "pos")
    rows = codes.withColumns({"tier": tier, "within": within}).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return rows.select("media_id", "code", "tier", needs_no_translation(F.col("code"), target).alias("skip"))
