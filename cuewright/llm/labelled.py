"""Labelled rows for the classifiers: a bounded sample to learn from, and what is held out."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle


def fold(mod: int, c: str = "doc_id") -> Column:
    """crc32 of doc_id as text (null: empty text) modulo ``mod``."""
    return F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: dict[int, int], max_bytes: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, y of at most ``most[y]`` training rows of each label, the first by a hash of doc_id, and how many
    documents have each label: bounds that cut one label more than the other change the labels' shares.

    Only ids and labels are joined and sorted, of documents that exist; the ids found go to the texts, which stay where
    they are. With ``max_bytes`` longer texts are left out after that.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y is not null").groupBy("_id").agg(F.max("y").alias("y"))
    known = known.where(train & F.col("y").isin(*most)).join(docs.select("doc_id"), F.col("_id") == F.col("doc_id"), "left_semi")
    known = settle(known, "labelled")
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = reduce(DataFrame.unionByName, [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in most.items()])
    found = docs.join(F.broadcast(picked), docs.doc_id == picked._id).select("doc_id", "text", "y")
    if max_bytes is not None:
        found = found.where(F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes)
    return found, {y: counts.get(y, 0) for y in most}


def stands_for(y: np.ndarray, counts: dict[int, int]) -> dict[int, float]:
    """How many documents of its label each row (label y) stands for."""
    return {k: max(1.0, n / max(1, int((y == k).sum()))) for k, n in counts.items()}
