"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a keyed hash. A source's target is met by whole epochs of all its blocks
plus the blocks of a keyed permutation that still fit; the first that did not fit is then cut at the document where the
words taken come closest to the target. The blocks to draw are quotas, one number for each source. A binary tree over the output shards parts the
quota vector at each node by a multivariate hypergeometric draw (seeded by the node's place), down to a vector for each
shard; shards then take disjoint runs of each source's permuted blocks, and order their rows by a keyed hash.

The driver holds a row for each of the ``MAX_SOURCES`` largest sources and for each block (at most ``MAX_BLOCKS`` and one a
source), and shards x sources numbers (at most ``MAX_CELLS``). Where there are more sources, targets are found by sums over
a table, and each of the smaller ones is one block, cut in Spark and given to shards by a keyed hash. Reruns agree:
everything follows from the seed and the rows.

Null and empty texts have size 0 and are taken 0 words; a source of size 0 has target 0. The null source comes last.
Documents hash by id and text, so null ids spread. Where a cut falls among rows that agree in both, as many of these
are taken as come closest to the target. An empty table gives an empty result. A very long text is one row as any other;
only its words are counted. Extra columns pass through ``mix``; its own are named ``shard`` and ``copy``, with _ behind
where there are such.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, restored, settle, slim, text_of, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
MAX_SOURCES, MAX_BLOCKS, MAX_SHARDS, MAX_CELLS = 65_536, 131_072, 16_384, 8_000_000
WORDS_PER_SHARD, BLOCKS_PER_SHARD, LEAST_BLOCKS = 1_000_000, 8, 1_024
SEED = 20_240_229
#: Groups that equal rows at a cut fall into.
SALTS = 4_096
DRAW = "array<struct<copy:int,shard:int,upto:bigint>>"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> list[Fraction]:
    """Shares of all sizes by cycled weights; beyond ``cap`` times its size a source's excess goes to the others by weight."""
    total = sum(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        left = Fraction(total - sum(cap * sizes[i] for i in full))
        share = sum(w[i] for i in range(len(sizes)) if i not in full)
        over = [i for i in range(len(sizes)) if i not in full and left * w[i] > cap * sizes[i] * share]
        if not over:
            return [Fraction(cap * s) if i in full else left * w[i] / share if share else Fraction(0) for i, s in enumerate(sizes)]
        full.update(over)


def rng(seed: int, *place) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr((seed, *place)).encode()).digest()[:16], "big"))


def split_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: how many blocks of each source a shard gets. Rows differ by one block at most; columns sum to the quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        n = int(q.sum()) * (mid - lo) // (hi - lo)
        left = rng(seed, "node", lo, hi).multivariate_hypergeometric(q, n, method="marginals") if n else np.zeros_like(q)
        todo += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _hash(seed: int, *more: Column) -> Column:
    return F.xxhash64(F.lit(seed).cast("bigint"), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text", *more)


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns({"_size": F.size(words(text_of())).cast("bigint"), "_h": _hash(seed)})


def _block(n_blocks: Column) -> Column:
    return F.pmod("_h", n_blocks)


@dataclass(frozen=True)
class Plan:
    """sources: src, source, source_size, target, n_blocks. per_block: src, block, draws (upto: hash bound of a cut, else
    null). edges: src, _h, take, one (draw): of the rows with that hash ``take`` get the draw. sizes: doc_id, source,
    _size, _h of all documents. small: whether sources and per_block may be broadcast."""

    sources: DataFrame
    per_block: DataFrame
    edges: DataFrame | None
    sizes: DataFrame
    small: bool

    def sent(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def ranked(by_source: DataFrame) -> DataFrame:
    """``by_source`` (settled) with ``rank`` by code point from 0, null last. The driver gets one count a partition."""
    parts = settle(by_source.where("source is not null").repartitionByRange("source").withColumn("_p", F.spark_partition_id()), "sources")
    counts = sorted((r._p, r["count"]) for r in parts.groupBy("_p").count().collect())
    before = by_source.sparkSession.createDataFrame([(p, sum(n for q, n in counts if q < p)) for p, _ in counts], "_p int, _before long")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("source")) - 1
    last = F.lit(sum(n for _, n in counts)).cast("bigint")
    cols = by_source.columns
    return parts.join(F.broadcast(before), "_p").select(*cols, rank.alias("rank")).unionByName(by_source.where("source is null").select(*cols, last.alias("rank")))


def water_level(sources: DataFrame, total: int, cap: int = MAX_EPOCHS) -> Fraction:
    """Words a unit of weight once no source (n, w) is above ``cap`` times its size; as ``targets``, by sums over a table."""
    level = Fraction(total, max(1, int(sources.agg(F.sum("w")).first()[0] or 0)))
    while True:
        big = lambda c, k: F.col(c).cast("decimal(38,0)") * F.lit(k).cast("decimal(38,0)")
        over = big("n", cap * level.denominator) < big("w", level.numerator)
        full, share = sources.agg(F.sum(F.when(over, F.col("n"))), F.sum(F.when(~over, F.col("w")))).first()
        new = Fraction(total - cap * int(full or 0), int(share)) if share else level
        if new == level:
            return level
        level = new


def cuts_at(equal: DataFrame) -> DataFrame:
    """src, need, _h, n (words), m (rows with that hash) of the documents to cut -> src, edge (hash), take, m: of the rows
    below ``edge`` all are taken, of those at it ``take``, so that the words come closest to the need."""
    run = F.sum("n").over(Window.partitionBy("src").orderBy("_h"))
    at = equal.withColumn("before", run - F.col("n")).where("before < need").groupBy("src").agg(F.max_by(F.struct("_h", "n", "m", F.col("need") - F.col("before")), "_h").alias("x")).select("src", "x.*")
    left = F.col(at.columns[-1])
    take = F.least(F.col("m"), F.floor(left * F.col("m") / F.greatest(F.col("n"), F.lit(1)) + 0.5))
    return at.select("src", F.col("_h").alias("edge"), take.cast("bigint").alias("take"), "m")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> Plan:
    spark = docs.sparkSession
    sizes = settle(sized(docs.select("doc_id", "text", "source"), seed).select("doc_id", "source", "_size", "_h"), "sizes")
    by_source = settle(sizes.groupBy("source").agg(F.sum("_size").alias("n")), "source-sizes")
    count, total = by_source.agg(F.count(F.lit(1)), F.sum("n")).first()
    total, small = int(total or 0), count <= MAX_SOURCES
    tail = None
    if small:
        rows = sorted(((r.source, int(r.n)) for r in by_source.collect()), key=lambda r: (r[0] is None, r[0] or ""))
        want = targets([n for _, n in rows], weights)
    else:
        of_rank = F.get(F.array(*[F.lit(x) for x in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
        table = settle(ranked(by_source).withColumn("w", of_rank), "weighed-sources")
        level = water_level(table, total)
        top = table.orderBy(F.desc("n"), "rank").limit(MAX_SOURCES)
        head = sorted(top.collect(), key=lambda r: r.rank)
        rows, want = [(r.source, int(r.n)) for r in head], [min(Fraction(MAX_EPOCHS * int(r.n)), level * r.w) for r in head]
        target = F.least(F.col("n") * F.lit(float(MAX_EPOCHS)), F.col("w") * F.lit(float(level)))
        tail = table.join(F.broadcast(top.select("rank")), "rank", "left_anti").select((F.col("rank") + len(rows)).alias("src"), "source", F.col("n").alias("source_size"), target.alias("target"), F.lit(1).alias("n_blocks"))
        tail = settle(tail, "small-sources")
    names, size = [r[0] for r in rows], [r[1] for r in rows]
    shards = min(MAX_SHARDS, max(1, MAX_CELLS // max(len(rows), 1)), max(1, math.ceil(total / WORDS_PER_SHARD)))
    aim = min(MAX_BLOCKS, max(LEAST_BLOCKS, BLOCKS_PER_SHARD * shards))
    n_blocks = [max(1, aim * s // max(total, 1)) for s in size]
    # Numbers stand for sources in all that follows; the null source has one too.
    known = spark.createDataFrame([(i, s, z, float(t), b) for i, (s, z, t, b) in enumerate(zip(names, size, want, n_blocks, strict=True))], "src long, source string, source_size long, target double, n_blocks int")
    placed = sizes.join(F.broadcast(known), sizes.source.eqNullSafe(known.source)).select("src", _block(F.col("n_blocks")).cast("int").alias("block"), "_size", "_h")
    words_in: dict[tuple[int, int], int] = {(r.src, r.block): int(r.n) for r in placed.groupBy("src", "block").agg(F.sum("_size").alias("n")).collect()}
    draws, cuts = [], []
    for i, name in enumerate(names):
        perm = rng(seed, "blocks", name).permutation(n_blocks[i]).tolist()
        whole = int(want[i] // size[i]) if size[i] else 0
        units = [(b, e) for e in range(whole) for b in perm]
        need = want[i] - whole * size[i]
        over = None
        for b in perm if need else []:
            n = words_in.get((i, b), 0)
            if n <= need:
                need -= n
                units.append((b, whole))
            elif over is None:
                over = b
        if over is not None and need:
            cuts.append((i, over, whole, float(need)))
            units.append((over, whole))
        draws.append(units)
    share = split_tree(np.array([len(u) for u in draws]), shards, seed) if names else np.zeros((1, 0), np.int64)
    at = [np.repeat(np.arange(shards), share[:, i]).tolist() for i in range(len(names))]
    # The cut: documents of the block by hash. One row for each source comes back.
    bound: dict[int, tuple[int, int, int]] = {}
    if cuts:
        cut = spark.createDataFrame([(i, b, need) for i, b, _, need in cuts], "src long, block int, need double")
        equal = placed.join(F.broadcast(cut), ["src", "block"]).groupBy("src", "need", "_h").agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("m"))
        bound = {r.src: (r.edge, r.take, r.m) for r in cuts_at(equal).collect()}
    is_cut = {(i, b, e) for i, b, e, _ in cuts}
    flat, edge = [], []
    for i, units in enumerate(draws):
        for (b, e), s in zip(units, at[i], strict=True):
            h, take, m = bound.get(i, (-(2**63) + 1, 0, 0)) if (i, b, e) in is_cut else (None, 0, 0)
            flat.append((i, b, e, s, h if h is None or (m and take == m) else h - 1))
            if 0 < take < m:
                edge.append((i, h, take, (e, s, None)))
    drawn = spark.createDataFrame(flat, "src long, block int, copy int, shard int, upto long")
    per_block = drawn.groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", "upto"))).cast(DRAW).alias("draws"))
    edges = spark.createDataFrame(edge, "src long, _h long, take long, one struct<copy:int,shard:int,upto:bigint>")
    if tail is not None:
        more, more_edges = small_draws(sizes, tail, shards, seed)
        known, per_block, edges = known.unionByName(tail), per_block.unionByName(more), edges.unionByName(more_edges)
    edges = settle(edges, "edges-of-cuts") if tail is not None or edge else None
    return Plan(known, per_block, edges if edges is not None and edges.limit(1).count() else None, sizes, small)


def small_draws(sizes: DataFrame, tail: DataFrame, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """per_block and edges of sources (as ``Plan.sources``) that are one block each, without the driver."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    own = settle(tail.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "small-needs")
    cut = own.where("need > 0")
    equal = sizes.join(cut, sizes.source.eqNullSafe(cut.source)).groupBy("src", "need", "_h").agg(F.sum("_size").alias("n"), F.count(F.lit(1)).alias("m"))
    both = own.join(cuts_at(equal), "src", "left")
    place = lambda copy: F.struct(copy.alias("copy"), F.pmod(F.xxhash64(F.lit(seed), "src", copy), F.lit(shards)).cast("int").alias("shard"))
    draw = lambda copy, upto: F.struct(place(copy)["copy"].alias("copy"), place(copy)["shard"].alias("shard"), upto.cast("bigint").alias("upto"))
    none = F.array().cast(DRAW)
    epochs = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0), F.col("whole") - 1), lambda e: draw(e, F.lit(None)))).otherwise(none)
    last = F.when(F.col("edge").isNotNull(), F.array(draw(F.col("whole"), F.when(F.col("take") == F.col("m"), F.col("edge")).otherwise(F.col("edge") - 1)))).otherwise(none)
    per_block = both.select("src", F.lit(0).alias("block"), F.concat(epochs, last).cast(DRAW).alias("draws"))
    edges = both.where("take > 0 and take < m").select("src", F.col("edge").alias("_h"), "take", draw(F.col("whole"), F.lit(None)).alias("one"))
    return per_block, edges


def _rows(docs: DataFrame, p: Plan) -> DataFrame:
    """``docs`` (with _size, _h) with src, source_size, target and ``draws``: the copies taken of each."""
    k = p.sources.withColumnRenamed("source", "_source")
    placed = docs.join(p.sent(k), docs.source.eqNullSafe(k._source)).drop("_source").withColumn("block", _block(F.col("n_blocks")).cast("int"))
    out = placed.join(p.sent(p.per_block), ["src", "block"], "left").withColumn("draws", F.coalesce(F.filter("draws", lambda x: x["upto"].isNull() | (F.col("_h") <= x["upto"])), F.array().cast(DRAW)))
    if p.edges is None:
        return out
    found = out.join(p.sent(p.edges), ["src", "_h"], "left")
    return found.where("take is null").drop("take", "one").unionByName(_numbered(found.where("take is not null"), out.columns))


def _numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows at a cut: the first ``take`` of each source get the draw ``one`` too.

    Rows are counted where they agree in all, in ``SALTS`` groups, and counts are added up by groups and then within them,
    so that no task gets all of very many copies.
    """
    alike = rows.withColumn("_all", F.to_json(F.struct(*columns))).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    counted = alike.groupBy("src", "_all", "_salt").agg(F.first(F.struct(*columns)).alias("row"), F.first("take").alias("take"), F.first("one").alias("one"), F.count(F.lit(1)).alias("m"))
    counted = settle(counted.withColumn("_group", F.pmod(F.xxhash64("_all", "_salt"), F.lit(SALTS))), "rows-at-cuts")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = counted.groupBy("src", "_group").agg(F.sum("m").alias("m")).select("src", "_group", F.coalesce(F.sum("m").over(before("src", ["_group"])), F.lit(0)).alias("ahead"))
    within = counted.join(groups, ["src", "_group"]).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("m").over(before("src", "_group", ["_all", "_salt"])), F.lit(0)))
    each = within.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m")))).select("row.*", "one", (F.col("ahead") + F.col("_n") <= F.col("take")).alias("_in"))
    return each.withColumn("draws", F.when(F.col("_in"), F.concat("draws", F.array("one")).cast(DRAW)).otherwise(F.col("draws"))).drop("one", "_in")


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    p = plan(docs, weights, seed)
    return _rows(p.sizes, p).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.size("draws") * F.col("_size")).cast("bigint").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``docs``, a row for each copy drawn, with ``shard`` and ``copy``; shards lie together, each in a keyed random order."""
    p = plan(docs, weights, seed)
    shard, copy = free_name("shard", docs.columns), free_name("copy", docs.columns)
    out = _rows(sized(slim(docs, "source"), seed), p).withColumn("_d", F.explode("draws")).withColumn("_order", F.xxhash64("_h", F.col("_d.copy"), F.lit(seed + 1)))
    out = out.withColumns({shard: F.col("_d.shard"), copy: F.col("_d.copy")}).repartition(shard).sortWithinPartitions(shard, "_order")
    return restored(out, docs.columns, "source", extra=(shard, copy))
