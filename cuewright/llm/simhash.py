"""SimHash near-duplicates, linked exactly through vantage-point trees.

A fingerprint has 64 bits; two link at ``RADIUS`` = 3 or fewer differing bits. Of the two 32-bit halves one then
differs in 1 bit at most, so pairs are looked for in two vantage-point trees, each over the Hamming distance of one
half (a metric too) with radius 1: far fewer points lie within 1 of a split than within 3 of it over 64 bits.

A node has a vantage point and a threshold: points up to the threshold go left, the others right, and those within the
radius of the threshold go right too, as by the triangle inequality no other left point can link to a right one. The
top of each tree is fitted on a bounded sample of the distinct fingerprints (at most ``SAMPLE``) and sent to all tasks; its
leaves are the shards, whose number grows with the fingerprints. Every distinct fingerprint is routed to the shards that
it may have a partner in; each shard grows its own subtree, parts by all 64 bits what one half can't part, and compares
its leaves exactly. Equal fingerprints are one point, so groups of copies cost nothing; a shard returns a spanning
forest of its links, not all pairs. Components follow in Spark.

A null or empty text has no shingle: fingerprint zero. Null doc_ids count as the smallest. Repeated rows come out as
often as they came in. An empty table gives an empty result. Extra columns pass through ``one_of_each``. A task's memory
is a small multiple of its longest text, whose shingles are hashed as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, ascii_lower, keyed, let, release, restored, sent_if_small, settle, slim, small_batches, text_of, words
from .components import components

RADIUS = 3
HALF_RADIUS = 1
#: Fingerprints that the top of a tree is fitted on, at most; points that a shard should get before those that go to
#: several are counted; shards at most, beyond which they grow (8 bytes a point).
SAMPLE, SHARD_POINTS, MAX_SHARDS = 262_144, 4_096, 65_536
LEAF, BLOCK = 256, 1_024
#: Points that are routed together.
ROUTED = 1 << 16


def shingle_hashes(text: Column) -> Column:
    """XXH64 (seed 42) of each 3-word shingle; of the whole sequence if there are 1 or 2 words."""

    def of(w: Column) -> Column:
        many = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2))))
        return F.when(F.size(w) >= 3, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(words(ascii_lower(text)), of)


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For rows hashes[offsets[i]:offsets[i+1]]: the bits set in over half, as int64."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    step = 1 << 15  # hashes at a time: 2 MB of bits
    counts = np.zeros((len(n), 64), np.int64)
    raw = np.ascontiguousarray(hashes, np.int64).view(np.uint64)
    at = 0
    while at < len(raw):
        upto = min(len(raw), at + step)
        i, j = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, upto, "left")
        bits = np.unpackbits(raw[at:upto].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        rows = np.arange(i, j)
        rows = rows[n[rows] > 0]
        starts = np.maximum(offsets[rows], at) - at
        counts[rows] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        at = upto
    out = np.packbits(2 * counts > n[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out.view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = b.column("hashes")
        offsets = h.offsets.to_numpy()
        fp = majority(h.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "hashes"), pa.array(fp)], names=[*(c for c in b.schema.names if c != "hashes"), "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _k, _v, fp of each document (``docs`` as ``keyed`` gives it)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "_k", "_v", shingle_hashes(text_of()).alias("hashes")).mapInArrow(_fingerprints, "doc_id long, _k long, _v long, fp long")


def halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = fp.view(np.uint64)
    return (u >> np.uint64(32)).astype(np.uint32), (u & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def split_at(points: np.ndarray, seed: int, radius: int = HALF_RADIUS) -> tuple[np.unsignedinteger, int] | None:
    """A vantage point of ``points`` and the threshold that parts them most evenly; None if none parts them."""
    rng = np.random.default_rng(seed)
    best = None
    for v in points[rng.integers(0, len(points), 3)]:
        sizes = np.bincount(np.bitwise_count(points ^ v), minlength=66)
        left = np.cumsum(sizes)
        again = left - np.append(np.zeros(radius, np.int64), left)[: len(left)]
        cost = np.maximum(left, len(points) - left + again)
        cost[left == 0] = cost[left == len(points)] = len(points) + 1
        m = int(np.argmin(cost))
        if cost[m] < 0.95 * len(points) and (best is None or cost[m] < best[0]):
            best = (cost[m], v, m)
            if cost[m] < 0.6 * len(points):
                break
    return best and best[1:]


def fit_top(points: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, threshold, left, right); a leaf has threshold -1 and its shard's number as left."""
    nodes: list[tuple[int, int, int, int]] = []
    leaf = max(2, len(points) // shards)
    leaves = 0
    todo: list[tuple[np.ndarray, int, str]] = [(points, -1, "")]
    while todo:
        p, parent, side = todo.pop()
        me = len(nodes)
        cut = split_at(p, me) if len(p) > leaf else None
        if cut is None:
            nodes.append((0, -1, leaves, 0))
            leaves += 1
        else:
            nodes.append((int(cut[0]), cut[1], 0, 0))
            d = np.bitwise_count(p ^ cut[0])
            todo += [(p[d > cut[1]], me, "r"), (p[d <= cut[1]], me, "l")]
        if parent >= 0:
            v, m, left, right = nodes[parent]
            nodes[parent] = (v, m, me, right) if side == "l" else (v, m, left, me)
    return nodes


def route(nodes: list[tuple[int, int, int, int]], points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, indexes of the points that it gets)."""
    todo = [(0, np.arange(len(points)))]
    while todo:
        k, at = todo.pop()
        if not len(at):
            continue
        v, m, left, right = nodes[k]
        if m < 0:
            yield left, at
            continue
        d = np.bitwise_count(points[at] ^ np.uint32(v))
        todo += [(right, at[d > m - HALF_RADIUS]), (left, at[d <= m])]


class Forest:
    """Union-find with path halving over points 0 to n - 1; keeps the pairs that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.pairs: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.pairs.append((i, j))


def links(half: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the points that link over 64 bits, by a subtree over this half; where the half
    does not part points any more, by one over all 64 bits."""
    forest = Forest(len(fp))

    def compare(at: np.ndarray) -> None:
        label = np.arange(len(at))  # of this leaf, so that its links come down to a few before they go to the forest
        for lo in range(0, len(at), BLOCK):  # blocks, so that a leaf that can't be parted stays small in memory
            x = at[lo : lo + BLOCK]
            for hi in range(lo, len(at), BLOCK):
                near = np.bitwise_count(fp[x][:, None] ^ fp[at[hi : hi + BLOCK]][None, :]) <= RADIUS
                for k in np.flatnonzero(near.sum(axis=1) > (lo == hi)):
                    p, q = lo + k, hi + np.flatnonzero(near[k])
                    while (new := np.flatnonzero(label[q] != label[p])).size:
                        other = q[new[0]]
                        forest.join(int(at[p]), int(at[other]))
                        label[label == label[other]] = label[p]

    todo = [(np.arange(len(fp)), 0, False)]
    while todo:
        at, depth, whole = todo.pop()
        if len(at) <= LEAF:
            if len(at) > 1:
                compare(at)
            continue
        points, radius = (fp, RADIUS) if whole else (half, HALF_RADIUS)
        cut = split_at(points[at], depth, radius)
        if cut is None:
            if whole:
                compare(at)
            else:
                todo.append((at, depth, True))
            continue
        d = np.bitwise_count(points[at] ^ cut[0])
        todo += [(at[d > cut[1] - radius], depth + 1, whole), (at[d <= cut[1]], depth + 1, whole)]
    pairs = np.array(forest.pairs, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _route_to_shards(tops):
    def routed(fp: np.ndarray) -> pa.RecordBatch:
        shards, rows = [], []
        for tree, half in enumerate(halves(fp)):
            for shard, at in route(tops.value[tree], half):
                shards.append(np.full(len(at), 2 * shard + tree, np.int64))
                rows.append(fp[at])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards)), pa.array(np.concatenate(rows))], names=["shard", "fp"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            if len(b):
                held.append(b.column("fp").to_numpy())
            if sum(map(len, held)) >= ROUTED:
                yield routed(np.concatenate(held))
                held = []
        if held:
            yield routed(np.concatenate(held))

    return over


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; holds one shard at a time."""

    def of(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        fp = np.concatenate(parts)
        i, j = links(halves(fp)[shard & 1], fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    now, held = None, []
    for b in batches:
        s, fp = b.column("shard").to_numpy(), b.column("fp").to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s)) if len(s) else np.zeros(1, int)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if now is not None and s[lo] != now:
                yield of(now, held)
                held = []
            now = int(s[lo])
            held.append(fp[lo:hi])
    if held:
        yield of(now, held)


def fingerprint_links(points: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) whose components are those of all pairs within ``RADIUS``."""
    spark = points.sparkSession
    n = points.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = np.array([r.fp for r in points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE).collect()], np.int64)
    shards = int(min(MAX_SHARDS, max(1, n // SHARD_POINTS), max(1, len(sample) // 4)))
    tops = spark.sparkContext.broadcast([fit_top(np.sort(h), shards) for h in halves(sample)])
    at = points.select("fp").mapInArrow(_route_to_shards(tops), "shard long, fp long")
    return at.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, _k, _v, fp, component (smallest _k reachable), root of each row of ``docs`` (as ``keyed`` gives it).

    ``root`` is the group's smallest fingerprint: one of each group, where groups may share their smallest _k.
    """
    prints = settle(fingerprints(docs), "fingerprints")
    points = settle(prints.groupBy("fp").agg(F.min("_k").alias("least")), "points")
    roots = components(fingerprint_links(points))
    grouped = points.join(roots, points.fp == roots.node).select("fp", "root", "least")
    names = grouped.groupBy("root").agg(F.min("least").alias("component"))
    named = grouped.join(names, "root").select("fp", "root", "component")
    # Each point's least id, or its component's; a fingerprint with very many documents is split by the skew join.
    final = settle(points.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), F.coalesce("root", "fp").alias("root")), "classes")
    release(points)
    return prints.join(final, "fp").select("doc_id", "_k", "_v", "fp", "component", "root")


def simhash_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    out = near_duplicates(keyed(docs.select("doc_id", "text")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the smallest doc_id, in one copy."""
    d = keyed(slim(docs))
    found = near_duplicates(d.select("doc_id", "text", "_k", "_v"))
    again = d.select("_v").where("_v <> 0").limit(1).count()
    gone = found.where("_k <> component").select("_k", "_v")
    if again:
        # By group, not by _k: groups that share their smallest doc_id (null, or one given twice) each keep a document.
        first = found.where("_k = component").groupBy("root").agg(F.min("_v").alias("_first"))
        others = found.where("_k = component").join(first, "root").where("_v <> _first")
        gone = gone.unionByName(others.select("_k", "_v")).distinct()
    # The others go by their keys, of which there are fewer than of those that stay.
    kept = d.join(sent_if_small(settle(gone, "near-duplicates")), ["_k", "_v"], "left_anti")
    if again:  # rows of one doc_id with one text: keep one
        kept = kept.dropDuplicates(["_k", "_v"])
    return restored(kept, docs.columns)
