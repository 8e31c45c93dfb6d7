"""Line de-duplication by a range-partitioned sort of line hashes.

Rows (hash of a line's key, document, position) are range-partitioned and sorted by all three, so that a line with
billions of copies spreads over many tasks. Each task streams its rows and decides every run of one hash that lies
inside it. Runs that touch a task's edge, or outgrow one batch, stay open: a map-side combined count settles them
(one row for each such hash). Decisions come back as one compressed keep bitmap for each document that loses
lines; text is never moved in the first half. The rows are settled before they are sorted, as the range partitioner reads them twice.

A null or empty text is one empty line. Keys of fewer than ``MIN_CHARS`` code points never go, so blank lines stay.
A null doc_id is the smallest. Rows of one doc_id are one document for counting, and each row loses the same keys;
equal rows count once, cost one row and get equal results. An empty table gives an empty result. A very long text is
split into its lines in one task. Extra columns pass through ``drop_lines``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, keyed, once, passed, release, restored, settle, slim, small_batches, text_of

MIN_CHARS, MIN_DOCS = 20, 3
#: A run with more rows than this is settled by the combined count instead of being held in memory.
MAX_HELD = 1 << 16


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2 (128 bits of hash together), _k, _v, pos of every line that is long enough."""
    rows = docs.select("_k", "_v", F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    rows = rows.where(F.char_length("line") >= min_chars).select("_k", "_v", "pos", line_key(F.col("line")).alias("key"))
    return rows.where(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "_k", "_v", "pos")


def run_verdicts(min_docs: int):
    """mapInArrow over sorted rows: those to drop (open false) and those of runs that this task can't settle (open true)."""

    def of(c: dict[str, np.ndarray], final: bool, head: bool) -> tuple[list[pa.RecordBatch], dict[str, np.ndarray]]:
        n = len(c["h1"])
        if not n:
            return [], c
        new = np.ones(n, bool)
        new[1:] = (c["h1"][1:] != c["h1"][:-1]) | (c["h2"][1:] != c["h2"][:-1])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        other = new.copy()
        other[1:] |= c["_k"][1:] != c["_k"][:-1]
        docs = np.add.reduceat(other.astype(np.int64), starts)
        last = c["_k"][np.append(starts[1:], n) - 1]
        unsure = np.zeros(len(starts), bool)
        unsure[0] = head
        held = 0
        if final:
            unsure[-1] = True
        elif n - starts[-1] <= MAX_HELD:
            held = n - starts[-1]
        else:
            unsure[-1] = True
        lose = (docs[run] >= min_docs) & (c["_k"] != last[run])
        take = (unsure[run] | lose)
        take[n - held :] = False
        out = []
        if take.any():
            out.append(pa.RecordBatch.from_arrays([pa.array(c[k][take]) for k in ("h1", "h2", "_k", "_v", "pos")] + [pa.array(unsure[run][take])], names=["h1", "h2", "_k", "_v", "pos", "open"]))
        return out, {k: v[n - held :] for k, v in c.items()}

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        first: tuple | None = None
        broken: tuple | None = None
        for b in batches:
            c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2", "_k", "_v", "pos")}
            if not len(c["h1"]):
                continue
            if held is not None:
                c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
            first = first or (c["h1"][0], c["h2"][0])
            at = (c["h1"][0], c["h2"][0])
            out, held = of(c, False, at == first or at == broken)
            if not len(held["h1"]):
                broken = (c["h1"][-1], c["h2"][-1])  # went out as open; what follows of it is open too
            yield from out
        if held is not None and len(held["h1"]):
            yield from of(held, True, False)[0]

    return over


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """_k, _v, pos of each line to drop, once. ``docs`` as ``keyed`` gives it."""
    small_batches(docs.sparkSession)
    hashed = settle(line_rows(once(docs), min_chars), "line-hashes")
    rows = hashed.repartitionByRange("h1", "h2", "_k").sortWithinPartitions("h1", "h2", "_k", "pos")
    found = settle(rows.mapInArrow(run_verdicts(min_docs), "h1 long, h2 long, _k long, _v long, pos int, open boolean"), "line-runs")
    release(hashed)
    unsure = found.where("open")
    # A document is one for each (hash, _k): the first aggregation drops its repeats, the second counts; both combine before they shuffle.
    counts = unsure.groupBy("h1", "h2", "_k").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.sum("one").alias("docs"), F.max("_k").alias("last")).where(F.col("docs") >= min_docs)
    # Read back from a table, both sides of the join are plain exchanges, of which adaptive execution splits a skewed one.
    late = unsure.join(settle(counts, "line-counts"), ["h1", "h2"]).where(F.col("_k") != F.col("last"))
    return found.where("not open").select("_k", "_v", "pos").unionByName(late.select("_k", "_v", "pos"))


def pack(kept: np.ndarray) -> bytes:
    """A keep bitmap (1 is keep, most significant bit first), deflated."""
    return zlib.compress(np.packbits(kept).tobytes(), 6)


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for gone in b.column("gone"):
            at = np.asarray(gone.values)
            kept = np.ones(int(at.max()) + 1, bool)
            kept[at] = False
            maps.append(pack(kept))
        yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_v"), pa.array(maps, pa.binary()), pa.array([int(x.values.to_numpy().max()) + 1 for x in b.column("gone")], pa.int32())], names=["_k", "_v", "_keep", "_upto"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """_k, _v, _keep (bitmap of the first ``_upto`` lines; all later ones stay) of each document that loses lines."""
    gone = dropped_lines(docs, min_chars, min_docs).groupBy("_k", "_v").agg(F.collect_list("pos").alias("gone"))
    return gone.mapInArrow(_bitmaps, "_k long, _v long, _keep binary, _upto int")


def apply_bitmap(text: bytes, keep: bytes | None, upto: int | None) -> tuple[bytes, int, int]:
    """What stays, lines before, lines dropped."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    stays = unpack(keep, upto)
    left = [x for x, k in zip(lines, stays, strict=False) if k] + lines[upto:]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def _applied(with_text: bool):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            rows = [apply_bitmap(t.as_py() or b"", k.as_py(), u.as_py()) for t, k, u in zip(texts, b.column("_keep"), b.column("_upto"), strict=True)]
            rest = [c for c in b.schema.names if c not in ("text", "_keep", "_upto")]
            made = {"n_lines": pa.array([r[1] for r in rows], pa.int64()), "n_dropped": pa.array([r[2] for r in rows], pa.int64())}
            if with_text:
                made["text"] = pa.array([None if t is None and not r[2] else r[0] for t, r in zip(texts.to_pylist(), rows, strict=True)], pa.binary()).cast(pa.string())
            else:
                made["kept_sha256"] = pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [*made.values()], names=[*rest, *made])

    return over


def line_digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    d = keyed(docs.select("doc_id", "text"))
    both = d.join(keep_bitmaps(d, min_chars, min_docs), ["_k", "_v"], "left").select("doc_id", "text", "_keep", "_upto")
    return both.mapInArrow(_applied(False), "doc_id long, n_lines long, n_dropped long, kept_sha256 string").select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without its repeated lines."""
    d = keyed(slim(docs))
    both = d.join(keep_bitmaps(d, min_chars, min_docs), ["_k", "_v"], "left").select("doc_id", "_rest", "text", "_keep", "_upto")
    out = both.mapInArrow(_applied(True), passed(both.schema, "doc_id", "_rest") + ", n_lines long, n_dropped long, text string")
    return restored(out, docs.columns)
