"""Removal of words that an earlier 20-word window covers, on a compacted de Bruijn graph.

A 20-word window is an edge between its first and its last 19 words. Edges in a row that share a minimizer are compacted
on the spot into one short path (``superkmers``); equal ones of the corpus are joined into classes. Classes that always follow
each other are compacted into repeated nonbranching paths, which lose every occurrence but the first at once. Where a
minimizer lies on several short paths, these may share some edges only: they are opened into single edges, equal edges are
joined, and the source coordinates of the first stay. Documents get back their removed spans by their coordinates.

Null and empty texts have no words. A null doc_id is the smallest. Rows of one doc_id with unlike texts are ordered
among themselves by a hash of the text; rows alike in both are one document and get equal results. An empty table
gives an empty result. A very long text is read in chunks, and its paths end where a stretch of ``superkmers`` does; a
task holds it once, with its spans. Extra columns pass through ``drop_repeated_words``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, once, passed, release, restored, settle, slim, small_batches
from .hashes import window_hashes
from .superkmers import classes_of, each_with_spans, grouped, later_ones, occurrences, opened, settle_windows, span_rows, stretch, word_hashes

WINDOW, MINIMIZER = 20, 6
PART = 1 << 20


def _open_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces into edges. Equal edges of a part are settled here; the rest of a parted group goes to a join."""
    for part in grouped(batches, PART):
        pieces = part["piece"]
        t, offset = word_hashes(np.frombuffer(b"".join(pieces), np.uint8), np.append(0, np.cumsum([len(x) for x in pieces])))
        piece = np.repeat(np.arange(len(pieces)), np.diff(offset))
        at = np.flatnonzero(offset[piece + 1] - np.arange(t.shape[1]) >= WINDOW)
        if not len(at):
            continue
        w1, w2 = window_hashes(t, WINDOW)[:, at]
        order = np.lexsort((w2, w1))
        at, w1, w2 = at[order], w1[order], w2[order]
        group = np.cumsum(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
        row = piece[at]
        yield from settle_windows(part, group, row, at - offset[row], w1, w2, WINDOW)


def linked_classes(found: DataFrame) -> DataFrame:
    """Classes of minimizer paths with what follows and precedes them: ``after`` and ``before`` (c, d), null unless it is
    the same one at every occurrence. Nothing follows across the end of a stretch, where a path may end early."""
    w = Window.partitionBy("_k", "_v", "_stretch").orderBy("at")
    start, size = F.shiftright("at", 16), F.col("at").bitwiseAND(F.lit(0xFFFF))
    near = found.withColumns({"_stretch": stretch("at"), "_end": start + size, "_start": start})
    follows, precedes = F.lead("_start").over(w) == F.col("_end"), F.lag("_end").over(w) == F.col("_start")
    near = near.withColumns({f"{x}{y}": F.when(cond, f(y).over(w)) for x, cond, f in (("a", follows, F.lead), ("b", precedes, F.lag)) for y in ("c", "d")})
    aggs = [f(f"{x}{y}").alias(f"{x}{y}_{name}") for x in "ab" for y in "cd" for name, f in (("min", F.min), ("max", F.max))]
    classes = classes_of(near, *aggs, F.count("ac").alias("a_n"), F.count("bc").alias("b_n"))
    same = lambda x: (F.col(f"{x}_n") == F.col("n")) & (F.col(f"{x}c_min") == F.col(f"{x}c_max")) & (F.col(f"{x}d_min") == F.col(f"{x}d_max"))
    one = lambda x: F.when(same(x), F.struct(F.col(f"{x}c_min").alias("c"), F.col(f"{x}d_min").alias("d")))
    out = classes.select("h", "c", "d", "first", "n", one("a").alias("after"), one("b").alias("before"))
    out._settled_at = classes._settled_at
    return out


def compact_paths(classes: DataFrame) -> DataFrame:
    """Repeated nonbranching paths: h, c, d of the first class, its first occurrence, length in windows, n occurrences; settled.

    Where two classes always follow each other their first occurrences do too, so a path is a run of
    first occurrences in one document, and a window over the source coordinates finds it without walking along the links.
    """
    rows = classes.where("n > 1").withColumns({"_k": F.col("first._k"), "_v": F.col("first._v"), "at": F.col("first.at"), "me": F.struct("c", "d")})
    size, start = F.col("at").bitwiseAND(F.lit(0xFFFF)), F.shiftright("at", 16)
    rows = rows.withColumns({"size": size, "start": start, "stretch": stretch("at")})
    w = Window.partitionBy("_k", "_v", "stretch").orderBy("at")
    back = lambda c: F.lag(c).over(w)
    joined = (back("me") == F.col("before")) & (back("after") == F.col("me")) & (back(F.col("start") + F.col("size")) == F.col("start")) & (back("n") == F.col("n"))
    rows = rows.withColumn("new", (~F.coalesce(joined, F.lit(False))).cast("int"))
    rows = rows.withColumn("path", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.when(F.col("new") == 1, F.struct("h", "c", "d", "first"))
    paths = rows.groupBy("_k", "_v", "stretch", "path").agg(F.first(head, ignorenulls=True).alias("head"), F.sum("size").alias("length"), F.first("n").alias("n"))
    return settle(paths.select("head.h", "head.c", "head.d", "head.first", "length", "n"), "paths")


def _paths(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    small_batches(docs.sparkSession)
    found = occurrences(docs, "word", WINDOW, MINIMIZER)
    classes = linked_classes(found)
    return found, classes, compact_paths(classes)


def repeated_words(docs: DataFrame) -> DataFrame:
    """_k, _v, start, end of word ranges to remove (overlapping). ``docs`` as ``keyed`` gives it."""
    docs = once(docs)
    found, classes, paths = _paths(docs)
    return later_ones(found, paths, WINDOW).unionByName(opened(docs, classes, "word", WINDOW, _open_up))


def repeated_paths(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (in words) of the first occurrence of each repeated nonbranching path, and its number of copies."""
    found, classes, paths = _paths(once(keyed(docs.select("doc_id", "text"))))
    release(found)
    release(classes)
    start = F.shiftright("first.at", 16)
    return paths.select(F.when(F.col("first._k") != NULL_ID, F.col("first._k")).alias("doc_id"), start.alias("start"), (start + F.col("length") - 1 + WINDOW).alias("end"), F.col("n").alias("copies"))


def kept_words(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], int]:
    words = text.tobytes().split()
    n = len(words)
    for s, e in zip(start[::-1].tolist(), end[::-1].tolist(), strict=True):
        del words[s:e]
    return words, n


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t, s, e in each_with_spans(b):
            words, n = kept_words(t, s, e)
            rows.append((n, n - len(words), len(s), hashlib.sha256(b" ".join(words)).hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"])


def word_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256."""
    d = keyed(docs.select("doc_id", "text"))
    return span_rows(d, repeated_words(d)).select("doc_id", "text", "_spans").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = [t if not len(s) else b" ".join(kept_words(x, s, e)[0]).decode("utf-8", "replace") for t, (x, s, e) in zip(b.column("text").to_pylist(), each_with_spans(b), strict=True)]
        rest = [c for c in b.schema.names if c not in ("text", "_spans")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(kept, pa.string())], names=[*rest, "text"])


def drop_repeated_words(docs: DataFrame) -> DataFrame:
    """``docs``; a text that loses words comes back as its other words with one space between them."""
    d = keyed(slim(docs))
    both = span_rows(d, repeated_words(d)).select("doc_id", "_rest", "text", "_spans")
    return restored(both.mapInArrow(_without, passed(both.schema, "doc_id", "_rest", "text")), docs.columns)
