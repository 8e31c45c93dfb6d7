"""Removal of bytes that an earlier 100-byte string covers, by two-stage suffix sorting.

``superkmers`` narrows the corpus to places where a minimizer occurs in unlike surroundings; those pieces are put end to
end in parts of ``PART`` bytes, never splitting a group that may share strings. Each part is suffix-sorted in two
stages: suffixes smaller than their successors are sorted directly (by 8 bytes at a time, to the depth that matters),
the others are induced by scans of the buckets of first bytes. Common prefixes of neighbours in the sorted order then
show equal 100-byte strings, of which the earliest stays.

Null and empty texts have no bytes. A null doc_id is the smallest. Rows of one doc_id with unlike texts are ordered
among themselves by a hash of the text; rows alike in both are one document and get equal results. An empty table
gives an empty result. A very long text is read in chunks and gathered by stretches; a task holds it once, with its
spans. Extra columns pass through ``drop_repeats``, which may cut a character in two: its text is read
back with replacement of the broken ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, passed, restored, slim
from .hashes import BYTE, window_hashes
from .superkmers import each_with_spans, grouped, repeats, settle_windows, span_rows

WINDOW, MINIMIZER = 100, 32
PART = 1 << 20


def byte_keys(text: np.ndarray, pad: int) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number, zeros beyond the end."""
    t = np.zeros(len(text) + pad + 8, np.uint64)
    t[: len(text)] = text
    have = 1
    while have < 8:
        t = (t[:-have] << np.uint64(8 * have)) | t[have:]
        have *= 2
    return t


def sorted_suffixes(at: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """``at`` by what follows each place, up to ``depth`` bytes."""
    if not len(at):
        return at
    at = at[np.argsort(keys[at], kind="stable")]
    k = keys[at]
    new = np.append(True, k[1:] != k[:-1])
    for d in range(8, depth, 8):
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        group = (np.cumsum(new) - 1)[tied]
        k = keys[at[tied] + d]
        order = np.lexsort((k, group))
        at[tied] = at[tied][order]
        k = k[order]
        new[tied] = np.append(True, (k[1:] != k[:-1]) | (group[1:] != group[:-1]))
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``text`` (uint8), sorted by their first ``depth`` bytes at least."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix is small if it sorts before its successor: the next differing byte is greater. The last one is not.
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    after = np.where(step != 0, np.arange(n), n)
    after = np.minimum.accumulate(after[::-1])[::-1]
    small = step[after] > 0
    keys = byte_keys(text, depth + 8)
    seeds = sorted_suffixes(np.flatnonzero(small), keys, depth)

    sizes = np.bincount(text, minlength=256)
    start = np.append(0, np.cumsum(sizes))[:256]
    large = np.bincount(text[~small], minlength=256)
    out = np.empty(n, np.int64)
    seed_at = np.append(0, np.cumsum(np.bincount(text[seeds], minlength=256)))
    for c in np.flatnonzero(sizes):
        out[start[c] + large[c] : start[c] + sizes[c]] = seeds[seed_at[c] : seed_at[c + 1]]
    head = start.copy()

    def induce(from_: np.ndarray) -> None:
        """Put the large predecessors of these suffixes, in this order, at the fronts of their buckets."""
        p = from_[from_ > 0] - 1
        p = p[~small[p]]
        if not len(p):
            return
        c = text[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        count = np.diff(np.append(first, len(c)))
        out[np.repeat(head[c[first]] - first, count) + np.arange(len(c))] = p
        head[c[first]] += count

    out[head[text[-1]]] = n - 1  # its successor is the empty suffix, the least of all
    head[text[-1]] += 1
    for c in np.flatnonzero(sizes):
        done = start[c]
        while done < head[c]:  # a run of one byte feeds its own bucket
            upto = head[c]
            induce(out[done:upto])
            done = upto
        induce(out[start[c] + large[c] : start[c] + sizes[c]])
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it, up to ``most``; 0 for the first."""
    keys = byte_keys(text, most + 8)
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for d in range(0, most, 8):
        x = keys[order[alive] + d] ^ keys[order[alive - 1] + d]
        same = x == 0
        # The first differing byte: a number's leading zero bits, by its exponent where that is exact enough.
        high = np.zeros(len(x), np.int64)
        for shift in (32, 16, 8):
            up = (x >> np.uint64(shift)) > 0
            high += np.where(up, shift, 0)
            x = np.where(up, x >> np.uint64(shift), x)
        out[alive] += np.where(same, 8, 7 - high // 8)
        alive = alive[same]
        if not len(alive):
            break
    return np.minimum(out, most)


def _open_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in grouped(batches, PART):
        pieces = part["piece"]
        length = np.array([len(x) for x in pieces])
        offset = np.append(0, np.cumsum(length))
        text = np.frombuffer(b"".join(pieces), np.uint8)
        order = suffix_array(text, WINDOW)
        piece = np.repeat(np.arange(len(pieces)), length)
        whole = offset[piece + 1] - np.arange(len(text)) >= WINDOW
        order = order[whole[order]]
        if not len(order):
            continue
        group = np.cumsum(common_prefixes(text, order, WINDOW) < WINDOW)
        row = piece[order]
        # Only windows of a group in several parts are compared beyond this one.
        w1, w2 = window_hashes(BYTE[:, text], WINDOW)[:, order] if part["parted"].any() else np.zeros((2, len(order)), np.uint64)
        yield from settle_windows(part, group, row, order - offset[row], w1, w2, WINDOW)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """_k, _v, start, end of byte ranges to remove (overlapping). ``docs`` as ``keyed`` gives it."""
    return repeats(docs, "byte", WINDOW, MINIMIZER, _open_up)


def cut(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    delta = np.zeros(len(text) + 1, np.int32)
    delta[start] += 1
    delta[end] -= 1
    return text[np.cumsum(delta[:-1]) == 0].tobytes()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(len(t), int((e - s).sum()), len(s), hashlib.sha256(cut(t, s, e) if len(s) else t.tobytes()).hexdigest()) for t, s, e in each_with_spans(b)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def byte_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    d = keyed(docs.select("doc_id", "text"))
    return span_rows(d, repeated_bytes(d)).select("doc_id", "text", "_spans").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = [t if not len(s) else cut(x, s, e).decode("utf-8", "replace") for t, (x, s, e) in zip(b.column("text").to_pylist(), each_with_spans(b), strict=True)]
        rest = [c for c in b.schema.names if c not in ("text", "_spans")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(kept, pa.string())], names=[*rest, "text"])


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``."""
    d = keyed(slim(docs))
    both = span_rows(d, repeated_bytes(d)).select("doc_id", "_rest", "text", "_spans")
    return restored(both.mapInArrow(_without, passed(both.schema, "doc_id", "_rest", "text")), docs.columns)
