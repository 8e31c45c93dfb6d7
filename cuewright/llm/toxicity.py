"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is lower-cased and parted into runs of letters and digits. Each word enters as a hashed word vector beside the
mean of its hashed runs of 3 and of 5 characters (bytes, its edges marked). Windows of ``WINDOW`` words, ``STRIDE`` apart (so neighbours overlap), each go
through a gated recurrent unit in either direction; attention weighs the states; a logit follows. A text's score is
that of its most toxic window, over all its windows, then put on a probability scale fitted on labelled rows that training
did not see.

The driver gets at most ``SAMPLE`` labelled texts of each label, in hash order, without those of more than ``MAX_BYTES``
bytes (documented bounds, some 190 MB at the most); it trains, on one core, on those of at most ``MAX_TRAIN_WORDS`` words, whole, and fits the scale on these and the
longer ones, at the shares that the labels have without the bounds. Scoring takes every word of every text, in pieces, however long it is. Null and empty texts, or texts without a letter or digit,
score as one window without words. Null labels and labels without documents are not learnt from; with labels of one
kind only, the score is that share. Repeated rows get equal scores; an empty table gives an empty result. Labels, lang,
source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .hashes import range_hashes, stirred
from .labelled import fold, sample, stands_for
from .superkmers import pieces, texts, word_bounds

WINDOW, STRIDE = 48, 36
WORDS, CHARS, WORD_DIM, CHAR_DIM, UNITS = 1 << 14, 1 << 14, 8, 8, 8
SAMPLE, MAX_TRAIN_WORDS, MAX_BYTES = {0: 4_000, 1: 2_000}, 800, 1 << 15
EPOCHS, BATCH, RATE = 6, 64, 0.01
HOLD_MOD, HELD, CUT = 4, 2, 0.3
#: Windows that pass through the network together.
BLOCK = 1_024

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


class Tokens:
    """The distinct words of some texts, and each text's words as numbers of these."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOW[data]
        starts, ends, self.at = word_bounds(data, offsets, _GAP)
        if not len(starts):
            self.ids, self.word, self.gram, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
            self.count = np.zeros((0, 1), np.float32)
            return
        h = range_hashes(data, starts, ends)[0]
        _, one, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.word = (h[one] >> np.uint64(50)).astype(np.int64)
        s, n = starts[one], (ends - starts)[one]
        self.first = np.append(0, np.cumsum(n))[:-1]
        place = np.arange(n.sum()) - np.repeat(self.first, n) + np.repeat(s, n)
        low, high = np.repeat(s, n), np.repeat(s + n, n)
        near = {d: np.where((place + d >= low) & (place + d < high), data[np.clip(place + d, 0, len(data) - 1)], 0).astype(np.uint64) for d in range(-2, 3)}
        three = (near[-1] << np.uint64(16)) | (near[0] << np.uint64(8)) | near[1]
        five = (near[-2] << np.uint64(40)) | (near[2] << np.uint64(32)) | three | np.uint64(1 << 56)
        self.gram = np.array([stirred(three), stirred(five)]) >> np.uint64(64 - CHARS.bit_length() + 1)
        self.gram = self.gram.astype(np.int64)
        self.count = n[:, None].astype(np.float32)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, windows x WINDOW, -1 beyond the end; lengths; the text of each window)."""
        n = np.diff(self.at)
        k = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, 1) * (n > 0)
        row = np.repeat(np.arange(len(n)), k)
        turn = np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(k))[:-1], k)
        begin = self.at[row] + turn * STRIDE
        size = np.minimum(self.at[row + 1] - begin, WINDOW)
        place = begin[:, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < size[:, None]
        ids = np.where(inside, self.ids[np.minimum(place, max(len(self.ids) - 1, 0))], -1) if len(row) else np.zeros((0, WINDOW), np.int64)
        return ids, size, row


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def reversed_rows(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each row's first ``size`` entries backwards."""
    at = size[:, None] - 1 - np.arange(ids.shape[1])
    return np.where(at >= 0, np.take_along_axis(ids, np.maximum(at, 0), 1), -1)


def gru(x: np.ndarray, size: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (windows x steps x UNITS) for inputs x (windows x steps x 3 UNITS); rows sorted by size, longest first."""
    n, steps, _ = x.shape
    out = np.zeros((n, steps, UNITS), np.float32)
    h = np.zeros((n, UNITS), np.float32)
    for t in range(steps):
        m = int(np.searchsorted(-size, -t, "left"))  # rows with size > t
        if not m:
            break
        old = h[:m]
        a = old @ u
        zr = sigmoid(x[:m, t, : 2 * UNITS] + a[:, : 2 * UNITS])
        z, r = zr[:, :UNITS], zr[:, UNITS:]
        c = np.tanh(x[:m, t, 2 * UNITS :] + r * a[:, 2 * UNITS :])
        new = c + z * (old - c)
        if keep is not None:
            keep.append((m, old.copy(), z, r, c, a[:, 2 * UNITS :]))
        h[:m] = new
        out[:m, t] = new
    return out


def gru_back(grad: np.ndarray, keep: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of u."""
    n, steps, _ = grad.shape
    gx, gu, gh = np.zeros((n, steps, 3 * UNITS), np.float32), np.zeros_like(u), np.zeros((n, UNITS), np.float32)
    for t in range(len(keep) - 1, -1, -1):
        m, old, z, r, c, ac = keep[t]
        g = gh[:m] + grad[:m, t]
        gc = g * (1 - z) * (1 - c * c)
        gz = g * (old - c) * z * (1 - z)
        gr = gc * ac * r * (1 - r)
        gx[:m, t] = np.hstack([gz, gr, gc])
        ga = np.hstack([gz, gr, gc * r])
        gu += old.T @ ga
        gh[:m] = g * z + ga @ u.T
    return gx, gu


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 0.3 / np.sqrt(s[0]) if len(s) > 1 and s[0] < 100 else 0.1, s).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.p = {"words": f(WORDS, WORD_DIM), "chars": f(CHARS, CHAR_DIM), "ahead": f(d, 3 * UNITS) * 3, "back": f(d, 3 * UNITS) * 3, "u_ahead": f(UNITS, 3 * UNITS), "u_back": f(UNITS, 3 * UNITS), "b_ahead": np.zeros(3 * UNITS, np.float32), "b_back": np.zeros(3 * UNITS, np.float32), "att": f(2 * UNITS, 2 * UNITS), "att_v": f(2 * UNITS, 1)[:, 0] * 3, "out": f(2 * UNITS, 1)[:, 0] * 3, "bias": np.zeros(1, np.float32)}
        self.flat: float | None = None
        self.scale, self.shift = 1.0, 0.0

    def words_in(self, t: Tokens) -> np.ndarray:
        p = self.p
        if not len(t.word):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        return np.hstack([p["words"][t.word], np.add.reduceat(p["chars"][t.gram].sum(0), t.first, axis=0) / t.count])

    def window_logits(self, vec: np.ndarray, ids: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Rows sorted by size, longest first."""
        p = self.p
        pad = lambda w, b: np.vstack([vec @ w + b, np.zeros((1, 3 * UNITS), np.float32)])  # noqa: E731  row -1 is the padding
        back = reversed_rows(ids, size)
        ka, kb = ([], []) if keep is not None else (None, None)
        ahead_h = gru(pad(p["ahead"], p["b_ahead"])[ids], size, p["u_ahead"], ka)
        back_h = gru(pad(p["back"], p["b_back"])[back], size, p["u_back"], kb)
        turn = np.maximum(size[:, None] - 1 - np.arange(ids.shape[1]), 0)
        inside = np.arange(ids.shape[1]) < size[:, None]
        h = np.concatenate([ahead_h, np.take_along_axis(back_h, turn[:, :, None], 1) * inside[:, :, None]], axis=2)
        q = np.tanh(h @ p["att"])
        e = np.where(inside, q @ p["att_v"], -1e9)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a = np.where(inside, a, 0)
        a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,ntd->nd", a, h)
        if keep is not None:
            keep.update(back=back, ka=ka, kb=kb, turn=turn, inside=inside, h=h, q=q, a=a, pooled=pooled)
        return pooled @ p["out"] + p["bias"][0]

    def gradients(self, t: Tokens, vec: np.ndarray, ids: np.ndarray, size: np.ndarray, k: dict, g: np.ndarray) -> dict[str, np.ndarray]:
        """For window logits' gradients g."""
        p, out = self.p, {}
        out["out"], out["bias"] = k["pooled"].T @ g, g.sum(keepdims=True)
        gp = g[:, None] * p["out"]
        h, a, q = k["h"], k["a"], k["q"]
        ga = np.einsum("nd,ntd->nt", gp, h)
        ge = a * (ga - (a * ga).sum(axis=1, keepdims=True))
        gq = ge[:, :, None] * p["att_v"] * (1 - q * q)
        out["att_v"] = np.einsum("nt,ntd->d", ge, q)
        out["att"] = np.einsum("ntd,nte->de", h, gq)
        gh = a[:, :, None] * gp[:, None, :] + gq @ p["att"].T
        gh_back = np.take_along_axis(gh[:, :, UNITS:] * k["inside"][:, :, None], k["turn"][:, :, None], 1) * k["inside"][:, :, None]
        gvec = np.zeros_like(vec)
        for name, grad, kept, at in (("ahead", gh[:, :, :UNITS] * k["inside"][:, :, None], k["ka"], ids), ("back", gh_back, k["kb"], k["back"])):
            gx, out[f"u_{name}"] = gru_back(grad, kept, p[f"u_{name}"])
            on = at >= 0
            per_word = np.zeros((len(vec), 3 * UNITS), np.float32)
            np.add.at(per_word, at[on], gx[on])
            out[name], out[f"b_{name}"] = vec.T @ per_word, per_word.sum(0)
            gvec += per_word @ p[name].T
        out["words"], out["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(out["words"], t.word, gvec[:, :WORD_DIM])
        per_gram = np.repeat(gvec[:, WORD_DIM:] / t.count, t.count[:, 0].astype(int), axis=0)
        for grams in t.gram:
            np.add.at(out["chars"], grams, per_gram)
        return out

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The greatest window logit of each text."""
        out = np.full(len(offsets) - 1, -np.inf, np.float32)
        for i, j in pieces(data, offsets):
            t = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            vec = self.words_in(t)
            ids, size, row = t.windows()
            order = np.argsort(-size, kind="stable")
            for lo in range(0, len(order), BLOCK):
                at = order[lo : lo + BLOCK]
                np.maximum.at(out, i + row[at], self.window_logits(vec, ids[at][:, : size[at[0]]], size[at]))
        out[np.isinf(out)] = self.p["bias"][0]
        return out

    def fit(self, rows: list[bytes], y: np.ndarray, seed: int = 4, weights: dict[int, float] | None = None) -> None:
        stands = np.where(y == 1, *((weights[1], weights[0]) if weights else (1.0, 1.0)))
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        check, learn = order[: len(rows) // 5], order[len(rows) // 5 :]
        short = np.array([len(word_bounds(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0]) <= MAX_TRAIN_WORDS for x in rows], bool)
        check, learn = np.append(check, learn[~short[learn]]), learn[short[learn]]
        if not len(learn) or len(np.unique(y[learn])) < 2:
            self.flat = float(np.average(y, weights=stands)) if len(y) else 0.5
            return
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(y == 1, 0.5 / max(y[learn].mean(), 1e-3), 0.5 / max(1 - y[learn].mean(), 1e-3))
        step = 0
        epochs = EPOCHS * max(1, min(6, 2_000 // len(learn)))
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
                t = Tokens(np.frombuffer(b"".join(rows[i] for i in at), np.uint8), np.append(0, np.cumsum([len(rows[i]) for i in at])))
                if not len(t.ids):
                    continue
                vec = self.words_in(t)
                ids, size, row = t.windows()
                by = np.argsort(-size, kind="stable")
                ids, size, row = ids[by][:, : size[by[0]]], size[by], row[by]
                k: dict = {}
                z = self.window_logits(vec, ids, size, k)
                # The greatest window, softly: its share of the text's gradient.
                top = np.full(len(at), -np.inf, np.float32)
                np.maximum.at(top, row, z)
                e = np.exp(z - top[row])
                total = np.zeros(len(at), np.float32)
                np.add.at(total, row, e)
                lse = top + np.log(np.maximum(total, 1e-9))
                err = np.where(np.isfinite(top), (sigmoid(np.where(np.isfinite(top), lse, 0)) - y[at]) * weight[at], 0) / len(at)
                step += 1
                for name, grad in self.gradients(t, vec, ids, size, k, (err[row] * e / total[row]).astype(np.float32)).items():
                    m[name] += 0.1 * (grad - m[name])
                    s[name] += 0.01 * (grad * grad - s[name])
                    self.p[name] -= RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-6)
        self.calibrate([rows[i] for i in check], y[check], [rows[i] for i in learn], y[learn], np.append(stands[check], stands[learn]))

    def calibrate(self, rows: list[bytes], y: np.ndarray, rows_too: list[bytes], y_too: np.ndarray, stands: np.ndarray | float = 1.0) -> None:
        """Scale and shift of logits by log loss on unseen rows, with the seen ones at a tenth of the weight; each as the rows that it stands for."""
        every = rows + rows_too
        z = self.logits(np.frombuffer(b"".join(every), np.uint8), np.append(0, np.cumsum([len(x) for x in every]))).astype(np.float64)
        want, w = np.append(y, y_too), np.append(np.ones(len(y)), np.full(len(y_too), 0.1)) * stands
        a, b = 1.0, 0.0
        for _ in range(400):
            p = sigmoid(a * z + b)
            g = w * (p - want) / w.sum()
            a, b = max(0.05, a - 0.3 * ((g * z).sum() + 1e-3 * (a - 1))), b - 0.3 * g.sum()
        self.scale, self.shift = float(a), float(b)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(offsets) - 1, self.flat)
        return sigmoid(self.scale * self.logits(data, offsets).astype(np.float64) + self.shift)


def _scores(net):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(net.value.score(*texts(b)))], names=["doc_id", "held_out", "score"])

    return over


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Network:
    some, counts = sample(docs.select("doc_id", "text"), labels, label, fold(HOLD_MOD, "_id") != HELD, SAMPLE, MAX_BYTES)
    rows = sorted(((r.doc_id, (r.text or "").encode(), r.y) for r in some.collect()), key=lambda r: (r[0], r[1]))
    net, y = Network(), np.array([r[2] for r in rows], np.float64)
    net.fit([r[1] for r in rows], y, weights=stands_for(y, counts))
    return net


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    net = spark.sparkContext.broadcast(fit(docs, labels, label))
    out = docs.select("doc_id", "text", (fold(HOLD_MOD) == HELD).alias("held_out")).mapInArrow(_scores(net), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
