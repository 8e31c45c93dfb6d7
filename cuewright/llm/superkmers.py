"""Repeated windows of tokens (bytes or words), found without a row for each window.

Each window of ``W`` tokens belongs to the least-hashed of its ``K``-token substrings, its minimizer (the leftmost of
equals). Windows in a row that share one minimizer form a super-k-mer: a row of 4 numbers for about (W - K) / 2 windows.
Equal windows have equal minimizers at equal offsets, so:

1. minimizers that occur once in the corpus have no repeated window (counted with map-side combining);
2. super-k-mers of one minimizer with equal tokens form a class: all but the first occurrence lose every window;
3. only where a minimizer has several classes may windows repeat across them. Of each such class the first occurrence
   is opened up and compared window by window, which is what the calling operator does by its own method.

Classes and windows are told apart by two hashes of 64 bits (``hashes``). Joins are on keys that adaptive execution can
split; a minimizer with very many classes is opened up in blocks whose results are merged by a combined minimum. What
is gathered by document is gathered by stretches of ``STRETCH`` tokens, so that a very long text is several groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, release, settle, small_batches
from .hashes import BYTE, Prefix, range_hashes, span_hashes

CHUNK = 1 << 18
#: Class-first occurrences of one minimizer that are opened up together.
BLOCK = 2_048
#: Pieces of text that a task holds before it passes them on.
PIECES = 20_000

#: Tokens of a document (as a power of 2) whose rows are gathered or ordered together.
STRETCH = 22
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: (minimizer tokens, ends of rows in tokens, both hash lanes of token ranges by start and end)
Tokens = tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    return BYTE[0][data], offsets, lambda start, end: range_hashes(data, start, end)


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in texts data[offsets[i]:offsets[i+1]], and the texts' offsets in words. ``gap``: by byte, whether it parts words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both lanes (2 x words), and the texts' offsets in words."""
    starts, ends, at = word_bounds(data, offsets)
    return range_hashes(data, starts, ends) if len(starts) else np.zeros((2, 0), np.uint64), at


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    both, at = word_hashes(data, offsets)
    return both[0], at, lambda start, end: span_hashes(both, start, end - start)


TOKENS: dict[str, Callable[[np.ndarray, np.ndarray], Tokens]] = {"byte": byte_tokens, "word": word_tokens}


def runs(t: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer hash, start, windows) of each super-k-mer of rows t[offsets[i]:offsets[i+1]]; len(t) < 2**24."""
    none = np.zeros(0, np.int64)
    if len(t) < window:
        return np.zeros(0, np.uint64), none, none
    g = Prefix(t, 0).all(k)
    low = np.uint64((1 << 24) - 1)
    anchor = (sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), window - k + 1) & low).astype(np.int64)
    # Window starts within a row: all but the last window - 1 tokens of each.
    n = np.diff(offsets)
    ok = np.ones(len(t) - window + 1, bool)
    for lo, hi in zip(offsets[1:] - np.minimum(n, window - 1), offsets[1:], strict=True):
        ok[lo:hi] = False
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(0, np.uint64), none, none
    a = anchor[at]
    new = np.append(True, (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    return g[a[first]], at[first], np.diff(np.append(first, len(at)))


def texts(b: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column and its offsets, without a copy; null is empty."""
    c = b.column(name)
    if c.null_count:
        c = c.fill_null("")
    wide = pa.types.is_large_string(c.type)
    offsets = np.frombuffer(c.buffers()[1], np.int64 if wide else np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) if len(c) else np.zeros(1, np.int64)
    data = np.frombuffer(c.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(c) and c.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = 4 * CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is alone."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def chunks(unit: str, data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[Tokens, int, int]]:
    """Tokens of several rows, or of one row by parts that overlap by a window less one token; the first row; the place in it."""
    for i, j in pieces(data, offsets, CHUNK if unit == "byte" else 4 * CHUNK):
        mine, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j > i + 1:
            yield TOKENS[unit](mine, ends), i, 0
        elif unit == "byte":
            for lo in range(0, len(mine) - window + 1, CHUNK):
                part = mine[lo : lo + CHUNK + window - 1]
                yield byte_tokens(part, np.array([0, len(part)])), i, lo
        else:
            t, _, content = word_tokens(mine, ends)
            for lo in range(0, len(t) - window + 1, CHUNK):
                part = t[lo : lo + CHUNK + window - 1]
                yield (part, np.array([0, len(part)]), lambda start, end, lo=lo, content=content: content(start + lo, end + lo)), i, lo


def super_kmers(unit: str, window: int, k: int, whole: bool):
    """mapInArrow (_k, _v, text) -> h, or with ``whole`` h, c, d, _k, _v, at (start * 2**16 + windows)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, variants = b.column("_k").to_numpy(), b.column("_v").to_numpy()
            for (t, at, content), i, lo in chunks(unit, *texts(b), window):
                h, start, n = runs(t, at, window, k)
                if not len(h):
                    continue
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])
                    continue
                row = np.searchsorted(at, start, "right") - 1
                c, d = content(start, start + n - 1 + window).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), c, d, keys[i + row], variants[i + row], ((start - at[row] + lo) << 16) | n)], names=["h", "c", "d", "_k", "_v", "at"])

    return over


def _widen(df: DataFrame) -> DataFrame:
    return df.withColumns({"start": F.shiftright("at", 16), "windows": F.col("at").bitwiseAND(F.lit(0xFFFF)).cast("int")})


def stretch(at: str) -> Column:
    return F.shiftright(at, 16 + STRETCH)


def occurrences(docs: DataFrame, unit: str, window: int, k: int) -> DataFrame:
    """h, c, d, _k, _v, at of the super-k-mers whose minimizer the corpus has at least twice; settled."""
    own = docs.select("_k", "_v", "text")
    again = settle(own.mapInArrow(super_kmers(unit, window, k, False), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "minimizers")
    found = settle(own.mapInArrow(super_kmers(unit, window, k, True), "h long, c long, d long, _k long, _v long, at long").join(again, "h"), "super-kmers")
    release(again)
    return found


def classes_of(found: DataFrame, *more) -> DataFrame:
    """h, c, d, first (_k, _v, at), n of each class, and the aggregates ``more``; settled."""
    return settle(found.groupBy("h", "c", "d").agg(F.min(F.struct("_k", "_v", "at")).alias("first"), F.count(F.lit(1)).alias("n"), *more), "classes")


def later_ones(found: DataFrame, heads: DataFrame, window: int) -> DataFrame:
    """_k, _v, start, end of all but the first occurrence. ``heads``: h, c, d, first, length (in windows)."""
    late = found.join(heads.select("h", "c", "d", "first", "length"), ["h", "c", "d"]).where(F.struct("_k", "_v", "at") != F.col("first"))
    return _widen(late).select("_k", "_v", "start", (F.col("start") + F.col("length") - 1 + window).alias("end"))


def opened(docs: DataFrame, classes: DataFrame, unit: str, window: int, open_up) -> DataFrame:
    """_k, _v, start, end of windows that repeat across unlike classes of one minimizer.

    ``open_up(rows)`` gets an iterator of (h, block, parted, _k, _v, start, windows, piece) batches and yields
    losers (open false: _k, _v, start, end) and, of minimizers in several blocks, first windows (open true, with w1, w2).
    """
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    firsts = _widen(classes.select("h", "first.*").join(several, "h"))
    blocks = F.ceil(F.col("classes") / BLOCK)
    block = F.pmod(F.xxhash64("_k", "_v", "at"), blocks)
    firsts = firsts.select("_k", "_v", stretch("at").alias("stretch"), F.struct("h", block.alias("block"), (blocks > 1).alias("parted"), "start", "windows").alias("one"))
    per_doc = firsts.groupBy("_k", "_v", "stretch").agg(F.collect_list("one").alias("ones"))
    contexts = docs.select("_k", "_v", "text").join(per_doc, ["_k", "_v"]).drop("stretch")
    contexts = contexts.mapInArrow(_contexts(unit, window), "h long, block long, parted boolean, _k long, _v long, start long, windows int, piece binary")
    found = contexts.repartition("h", "block").sortWithinPartitions("h", "block").mapInArrow(open_up, "open boolean, _k long, _v long, start long, end long, w1 long, w2 long")
    found = settle(found, "opened")
    release(classes)
    first = found.where("open")
    least = settle(first.groupBy("w1", "w2").agg(F.min(F.struct("_k", "_v", "start")).alias("first")), "first-windows")
    merged = first.join(least, ["w1", "w2"]).where(F.struct("_k", "_v", "start") != F.col("first"))
    cols = ["_k", "_v", "start", "end"]
    return found.where("not open").select(*cols).unionByName(merged.select(*cols))


def repeats(docs: DataFrame, unit: str, window: int, k: int, open_up) -> DataFrame:
    """_k, _v, start, end of token ranges that lose (overlapping; several a document). ``docs`` as ``keyed`` gives it."""
    small_batches(docs.sparkSession)
    docs = once(docs)
    found = occurrences(docs, unit, window, k)
    classes = classes_of(found)
    heads = settle(classes.where("n > 1").select("h", "c", "d", "first", F.col("first.at").bitwiseAND(F.lit(0xFFFF)).alias("length")), "heads")
    return later_ones(found, heads, window).unionByName(opened(docs, classes, unit, window, open_up))


def _contexts(unit: str, window: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = texts(b)
            ones = b.column("ones")
            at, flat = ones.offsets.to_numpy() - ones.offsets.to_numpy()[0], ones.flatten()
            field = {n: flat.field(n) for n in ("h", "block", "parted", "start", "windows")}
            start, windows = field["start"].to_numpy(), field["windows"].to_numpy().astype(np.int64)
            key, variant = b.column("_k"), b.column("_v")
            got: list[bytes] = []
            rows: list[np.ndarray] = []  # the document of each piece
            first = 0  # the first piece that was not given yet

            def out(upto: int, got=got, rows=rows, key=key, variant=variant, field=field) -> pa.RecordBatch:
                doc = pa.array(np.concatenate(rows))
                cols = [*(field[n][first:upto] for n in ("h", "block", "parted")), key.take(doc), variant.take(doc), field["start"][first:upto], field["windows"][first:upto], pa.array(got, pa.binary())]
                return pa.RecordBatch.from_arrays(cols, names=["h", "block", "parted", "_k", "_v", "start", "windows", "piece"])

            for i in range(len(b)):
                mine = data[offsets[i] : offsets[i + 1]]
                raw = mine.tobytes()
                bounds = word_bounds(mine, np.array([0, len(mine)])) if unit == "word" else None
                for x in range(int(at[i]), int(at[i + 1]), PIECES):
                    y = min(int(at[i + 1]), x + PIECES)
                    lo, hi = start[x:y], start[x:y] + windows[x:y] - 1 + window
                    if bounds is not None:
                        lo, hi = bounds[0][lo], bounds[1][hi - 1]
                    got += [raw[p:q] for p, q in zip(lo.tolist(), hi.tolist(), strict=True)]
                    rows.append(np.full(y - x, i))
                    if len(got) >= PIECES:
                        yield out(y)
                        first = y
                        got.clear()
                        rows.clear()
            if got:
                yield out(int(at[-1]))

    return over


def grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[dict[str, np.ndarray | list]]:
    """Rows sorted by (h, block) in parts of about ``size`` bytes of pieces, never parting a group."""
    held: list[pa.RecordBatch] = []
    have = 0

    def out(parts: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(parts)
        return {n: t.column(n).to_pylist() if n == "piece" else t.column(n).to_numpy() for n in t.schema.names}

    for b in batches:
        if not len(b):
            continue
        h, block = b.column("h").to_numpy(), b.column("block").to_numpy()
        edges = np.flatnonzero((h[1:] != h[:-1]) | (block[1:] != block[:-1])) + 1
        if held and (held[-1].column("h")[-1].as_py(), held[-1].column("block")[-1].as_py()) != (int(h[0]), int(block[0])):
            edges = np.append(0, edges)
        sizes = np.append(0, np.cumsum(pc.binary_length(b.column("piece")).to_numpy()))
        done = 0
        for e in edges:
            if have + sizes[e] - sizes[done] >= size:
                if e > done:
                    held.append(b.slice(done, e - done))
                if held:
                    yield out(held)
                held, have, done = [], 0, int(e)
        held.append(b.slice(done))
        have += int(sizes[-1] - sizes[done])
    if held:
        yield out(held)


def merged_ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal ranges of a union."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, s[1:] > e[:-1])
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:], len(s)) - 1]


def settle_windows(part: dict, group: np.ndarray, row: np.ndarray, index: np.ndarray, w1: np.ndarray, w2: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """Verdicts on windows: ``group`` (equal windows are neighbours and share it), their piece and place in that piece."""
    if not len(row):
        return
    where = part["start"][row] + index
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    rank = np.empty(len(row), np.int64)
    rank[np.lexsort((where, part["_v"][row], part["_k"][row]))] = np.arange(len(row))
    size = np.diff(np.append(first, len(row)))
    least = np.repeat(np.minimum.reduceat(rank, first), size)
    lost = rank != least
    if lost.any():
        order = np.lexsort((index[lost], row[lost]))
        r, x = row[lost][order], index[lost][order]
        new = np.append(True, (r[1:] != r[:-1]) | (x[1:] != x[:-1] + 1))
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(r)))
        start = part["start"][r[at]] + x[at]
        none = pa.array(np.zeros(len(at), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), bool)), pa.array(part["_k"][r[at]]), pa.array(part["_v"][r[at]]), pa.array(start), pa.array(start + n - 1 + window), none, none], names=["open", "_k", "_v", "start", "end", "w1", "w2"])
    keep = ~lost & part["parted"][row]
    if keep.any():
        start = where[keep]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(start), bool)), pa.array(part["_k"][row[keep]]), pa.array(part["_v"][row[keep]]), pa.array(start), pa.array(start + window), pa.array(w1[keep].view(np.int64)), pa.array(w2[keep].view(np.int64))], names=["open", "_k", "_v", "start", "end", "w1", "w2"])


def span_rows(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` (as ``keyed`` gives it) with ``_spans`` (array of start, end; null if none)."""
    per_doc = spans.groupBy("_k", "_v").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    return docs.join(per_doc, ["_k", "_v"], "left")


def each_with_spans(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text bytes, starts, ends of the maximal spans) of each row."""
    data, offsets = texts(b)
    c = b.column("_spans")
    none = np.zeros(0, np.int64)
    for i in range(len(b)):
        mine = data[offsets[i] : offsets[i + 1]]
        s = c[i].values
        if s is None or not len(s):
            yield mine, none, none
        else:
            yield mine, *merged_ranges(s.field("start").to_numpy(), s.field("end").to_numpy())
