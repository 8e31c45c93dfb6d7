"""Quality classifier: random-indexing word vectors, pooled by document, under a two-layer network.

Each hashed word has a sparse random index vector; its word vector is the sum of the index vectors of its neighbours
(two to either side) over the whole corpus. Tasks add up one fixed-size matrix each; sums combine by bucket, so the driver gets
``BUCKETS`` rows whatever the corpus. A document is the mean and the spread of its words' unit vectors, their mean
step from word to word, and its length. The network is trained in numpy on at most ``SAMPLE`` labelled rows (a
documented bound; hash order), its logits are shifted to the shares that the labels have without the bound, and its temperature is set on a part of these that it did not see.

Very long texts are pooled whole, a batch of texts in pieces. Null and empty texts pool to zeros and get the score of that vector. Null labels and labels without documents are
not learnt from; a label given twice counts once. With labels of one kind only, the score is that share. Repeated rows
get equal scores; an empty table gives an empty result. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .labelled import fold, sample, stands_for
from .superkmers import pieces, texts, word_hashes

BUCKETS, DIM, NONZERO, REACH = 1 << 13, 32, 4, 2
SAMPLE = {0: 8_000, 1: 16_000}
HIDDEN, EPOCHS, RATE = 32, 30, 3e-3
HOLD_MOD, HELD, CUT = 5, 0, 0.3
FEATURES = 3 * DIM + 2


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for i in range(NONZERO):
        out[np.arange(BUCKETS), (rng.integers(0, DIM, BUCKETS) + i * (DIM // NONZERO)) % DIM] += rng.choice([-1.0, 1.0], BUCKETS)
    return out


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, at = word_hashes(data, offsets)
    return (t[0] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), at


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, total = index_vectors(), np.zeros((BUCKETS, DIM))
    for b in batches:
        data, offsets = texts(b)
        for i, j in pieces(data, offsets):
            ids, begin = _buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(ids):
                continue
            row = np.repeat(np.arange(j - i), np.diff(begin))
            near = np.zeros((len(ids), DIM), np.float32)
            for d in range(1, REACH + 1):
                same = (row[d:] == row[:-d])[:, None]
                near[d:] += index[ids[:-d]] * same
                near[:-d] += index[ids[d:]] * same
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
            total[ids[order][first]] += np.add.reduceat(near[order], first, axis=0)
    used = np.flatnonzero(np.abs(total).sum(axis=1))
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(total[used, k]) for k in range(DIM))], names=["bucket", *(f"d{k}" for k in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM, unit length or zero."""
    cols = [f"d{k}" for k in range(DIM)]
    sums = docs.select("text").mapInArrow(_add_up, "bucket int, " + ", ".join(f"{c} double" for c in cols))
    rows = sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    out = np.zeros((BUCKETS, DIM), np.float32)
    for r in rows:
        out[r[0]] = r[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def pool(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for i, j in pieces(data, offsets):
        ids, begin = _buckets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = np.diff(begin)
        has = np.flatnonzero(n)
        if not len(has):
            continue
        v, first, size = vectors[ids], begin[has], n[has][:, None].astype(np.float32)
        mean = np.add.reduceat(v, first, axis=0) / size
        spread = np.sqrt(np.maximum(np.add.reduceat(v * v, first, axis=0) / size - mean**2, 0))
        step = np.zeros_like(v)
        step[1:] = np.abs(v[1:] - v[:-1])
        step[first] = 0
        moved = np.add.reduceat(step, first, axis=0) / size
        chars = np.diff(offsets[i : j + 1])[has][:, None]
        out[i + has] = np.hstack([mean, spread, moved, np.log1p(size), chars / size / 10])
    return out


class Network:
    """Standardised inputs, one hidden layer of tanh, a logit, a temperature. Adam on the log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, weights: dict[int, float] | None = None):
        # From the sample's odds to those of the rows that it stands for.
        bad, good = (weights[0], weights[1]) if weights else (1.0, 1.0)
        self.shift, stands = float(np.log(good / bad)), np.where(y == 1, good, bad)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        check, learn = order[: len(x) // 5], order[len(x) // 5 :]
        self.mid, self.scale = (x[learn].mean(0), x[learn].std(0) + 1e-3) if len(learn) else (np.zeros(FEATURES), np.ones(FEATURES))
        self.temperature, self.flat = 1.0, None
        if len(np.unique(y[learn])) < 2 if len(learn) else True:
            self.flat = float(np.average(y, weights=stands)) if len(y) else 0.5
            return
        z = (x - self.mid) / self.scale
        p = self.p = [rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
                h = np.tanh(z[at] @ p[0] + p[1])
                err = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[at]) / len(at)
                back = np.outer(err, p[2]) * (1 - h * h)
                step += 1
                for a, g, u, w in zip(p, [z[at].T @ back + 1e-4 * p[0], back.sum(0), h.T @ err + 1e-4 * p[2], err.sum(keepdims=True)], m, s, strict=True):
                    u += 0.1 * (g - u)
                    w += 0.001 * (g * g - w)
                    a -= RATE * (u / (1 - 0.9**step)) / (np.sqrt(w / (1 - 0.999**step)) + 1e-8)
        logits, want = self.logits(x[check]), y[check]
        loss = lambda t: np.average(np.logaddexp(0, logits / t) - want * logits / t, weights=stands[check])
        if len(check):
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mid) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3] + self.shift

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _features(vectors):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pool(*texts(b), vectors.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    return over


def _scores(vectors, net):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pool(*texts(b), vectors.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(net.value.score(x).astype(np.float64))], names=["doc_id", "held_out", "score"])

    return over


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality"):
    """(word vectors, network) as broadcast variables."""
    spark = docs.sparkSession
    small_batches(spark)
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    some, counts = sample(docs.select("doc_id", "text"), labels, label, fold(HOLD_MOD, "_id") != HELD, SAMPLE)
    rows = sorted(some.mapInArrow(_features(vectors), "doc_id long, y int, x array<float>").collect(), key=lambda r: (r.doc_id, r.x))
    x, y = np.array([r.x for r in rows], np.float64).reshape(-1, FEATURES), np.array([r.y for r in rows], np.float64)
    return vectors, spark.sparkContext.broadcast(Network(x, y, weights=stands_for(y, counts)))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    vectors, net = fit(docs, labels, label)
    out = docs.select("doc_id", "text", (fold(HOLD_MOD) == HELD).alias("held_out")).mapInArrow(_scores(vectors, net), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
