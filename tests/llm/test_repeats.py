import random

import numpy as np
import pytest

from cuewright.llm import debruijn, hashes, suffix_array, superkmers

from . import brute

DOC = "doc_id long, text string"


def check_bytes(spark, rows, parts=3):
    units = [(t or "").encode() for _, t in rows]
    want = []
    for (d, _), u, gone in zip(rows, units, brute.repeats(units, 100), strict=True):
        kept = bytes(c for i, c in enumerate(u) if i not in gone)
        want.append((d, len(u), len(gone), sum(i - 1 not in gone for i in gone), brute.sha(kept)))
    got = suffix_array.byte_digest(spark.createDataFrame(rows, DOC).repartition(parts))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    return sum(w[2] for w in want)


def check_words(spark, rows, parts=3):
    units = [brute.words(t) for _, t in rows]
    want = []
    for (d, _), u, gone in zip(rows, units, brute.repeats(units, 20), strict=True):
        want.append((d, len(u), len(gone), brute.sha(" ".join(w for i, w in enumerate(u) if i not in gone))))
    got = debruijn.word_digest(spark.createDataFrame(rows, DOC).repartition(parts)).drop("n_spans")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    return sum(w[2] for w in want)


def test_against_loop(spark, rows):
    pairs = [(r[0], r[1]) for r in rows]
    assert check_bytes(spark, pairs) > 1000
    assert check_words(spark, pairs) > 100


def patchwork(seed, n):
    """Texts cut from one another at odd places, with periods and short alphabets."""
    r = random.Random(seed)
    base = ["".join(r.choice("ab ") for _ in range(700)), "xyz " * 150, "".join(chr(r.randrange(97, 123)) if r.random() < 0.8 else " " for _ in range(900)), "é" * 300]
    out = []
    for i in range(n):
        s = ""
        for _ in range(r.randint(1, 4)):
            b = r.choice(base + out[-5:])
            x = r.randrange(max(1, len(b) - 1))
            s += b[x : x + r.randint(50, 300)]
        out.append(s)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(3))
def test_patchwork(spark, seed):
    assert check_bytes(spark, patchwork(seed, 40)) > 0
    check_words(spark, patchwork(seed, 40))


def test_blocks_and_small_chunks(spark, rows, monkeypatch):
    """One minimizer in several blocks, long texts in several chunks: the same rows."""
    monkeypatch.setattr(superkmers, "BLOCK", 2)
    check_bytes(spark, patchwork(9, 40))
    check_words(spark, [(r[0], r[1]) for r in rows])


def test_chunks(monkeypatch):
    r = np.random.default_rng(1)
    t = r.integers(0, 4, 5000).astype(np.uint8)
    t[3000:4000] = t[:1000]
    whole = superkmers.runs(hashes.BYTE[0][t], np.array([0, len(t)]), 100, 32)
    windows = sum(whole[2])
    assert windows == len(t) - 99
    by_window = {}
    for h, s, n in zip(*whole, strict=True):
        by_window |= {int(s) + i: int(h) for i in range(n)}
    assert all(by_window[i] == by_window[3000 + i] for i in range(901))


def test_empty_and_odd(none, odd, spark):
    assert suffix_array.byte_digest(none).count() == 0 and debruijn.word_digest(none).count() == 0
    got = [tuple(r) for r in suffix_array.byte_digest(odd).collect()]
    assert len(got) == 8
    t = len("Some words that are here to be counted and found again by all who look for them in this text of ours today")
    assert sorted((r[1], r[2]) for r in got if r[0] == 1) == [(t, t), (t, t), (t + 5, t)]
    assert sorted((r[1], r[2]) for r in got if r[0] is None) == [(0, 0), (t, 0), (t, 0)]
    assert suffix_array.drop_repeats(odd).columns == odd.columns and debruijn.drop_repeated_words(odd).columns == odd.columns
    words = [tuple(r) for r in debruijn.word_digest(odd).collect()]
    assert sorted((r[1], r[2]) for r in words if r[0] == 1) == [(23, 23), (23, 23), (24, 23)]


def test_texts_after_the_cut(spark):
    line = " ".join(f"word{i}" for i in range(25))
    d = spark.createDataFrame([(1, "a  " + line), (2, "b " + line + "  c\nd"), (3, None)], DOC)
    assert {r.doc_id: r.text for r in debruijn.drop_repeated_words(d).collect()} == {1: "a  " + line, 2: "b c d", 3: None}
    assert {r.doc_id: r.text for r in suffix_array.drop_repeats(d).collect()} == {1: "a  " + line, 2: "b  c\nd", 3: None}


def test_two_stage_sorting():
    for seed in range(200):
        r = np.random.default_rng(seed)
        t = (r.integers(0, int(r.integers(2, 5)), int(r.integers(1, 300))) + 65).astype(np.uint8)
        b = t.tobytes()
        order = suffix_array.suffix_array(t, 400)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shared = suffix_array.common_prefixes(t, order, 24)
        for k in range(1, len(b)):
            x, y = b[order[k - 1] :], b[order[k] :]
            n = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
            assert shared[k] == min(n, 24)


def test_paths(spark):
    """A passage of three texts is one path; a longer copy of its tail in one more text parts it."""
    r = random.Random(6)
    own = lambda k: " ".join(f"o{r.randrange(10**9)}" for _ in range(k))
    passage = own(90)
    rows = [(i, f"{own(30)} {passage} {own(30)}") for i in range(3)]
    got = debruijn.repeated_paths(spark.createDataFrame(rows, DOC)).collect()
    inner = max(got, key=lambda p: p.end - p.start)
    assert inner.doc_id == 0 and inner.copies == 3 and inner.end - inner.start > 70 and inner.start >= 30 and inner.end <= 120
    rows.append((3, " ".join(passage.split()[-45:])))
    parted = debruijn.repeated_paths(spark.createDataFrame(rows, DOC)).collect()
    assert {p.copies for p in parted} >= {3, 4}
    check_words(spark, rows)


def test_texts_longer_than_a_chunk(spark):
    """Cut into chunks at other places in either text; nothing that crosses a cut is lost."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9)))
    base = " ".join(word() for _ in range(60_000))
    assert len(base) > superkmers.CHUNK + 1000
    at = superkmers.CHUNK - 300
    rows = [(1, base), (2, "shifted by this " + base[at : at + 700]), (3, base[1000:] + " end")]
    assert check_bytes(spark, rows) > 300_000
    assert check_words(spark, rows) > 50_000


def test_more_words_than_a_chunk(spark):
    r = random.Random(9)
    w = [f"{r.randrange(10**5)}" for _ in range(superkmers.CHUNK + 3_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[superkmers.CHUNK - 60 : superkmers.CHUNK + 60]))]
    assert check_words(spark, rows) == 120


def two_words(bits):
    """Unlike words of 2**bits letters that a polynomial hash modulo 2**64 can't tell apart: each half is the other's complement."""
    a, b = "ab", "ba"
    while len(a) < 2**bits:
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    rows = []
    for bits in (9, 10, 11):
        r = random.Random(bits)
        own = [f"x{r.randrange(10**9)}" for _ in range(19)]
        a, b = two_words(bits)
        rows += [(10 * bits + 1, " ".join([*own, a])), (10 * bits + 2, " ".join([*own, b])), (10 * bits + 3, " ".join([*own, a, "more"]))]
    assert check_words(spark, rows) == 60
    assert check_bytes(spark, rows) > 0


def test_patchwork_of_confusing_words(spark):
    r = random.Random(12)
    base = [w for bits in (3, 5, 9, 10, 11) for w in two_words(bits)] + ["x", "y"]
    passages = [[r.choice(base) for _ in range(24)] for _ in range(6)]
    rows = [(i, " ".join(w for _ in range(3) for w in r.choice(passages)[r.randint(0, 3) :])) for i in range(30)]
    assert check_words(spark, rows) > 100


def test_hashes_tell_ranges_apart():
    r = np.random.default_rng(2)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    start = r.integers(0, 2000, 4000)
    end = start + r.integers(1, 900, 4000)
    both = hashes.range_hashes(data, start, end)
    raw = data.tobytes()
    texts = [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    for lane in both:
        assert len(set(lane.tolist())) == len(set(texts)) and len({(t, int(h)) for t, h in zip(texts, lane, strict=True)}) == len(set(texts))
    tokens = hashes.BYTE[:, data[:400]]
    at, size = r.integers(0, 300, 500), r.integers(1, 90, 500)
    spans = hashes.span_hashes(tokens, at, size)
    texts = [raw[s : s + n] for s, n in zip(at.tolist(), size.tolist(), strict=True)]
    assert all(len({(t, int(h)) for t, h in zip(texts, lane, strict=True)}) == len(set(texts)) == len(set(lane.tolist())) for lane in spans)
    for n in (1, 2, 7, 20, 100):
        windows = hashes.window_hashes(tokens, n)
        assert windows.shape == (2, 401 - n)
        texts = [raw[i : i + n] for i in range(401 - n)]
        assert all(len({(t, int(h)) for t, h in zip(texts, lane, strict=True)}) == len(set(texts)) == len(set(lane.tolist())) for lane in windows)


def test_stretches_part_what_is_gathered(spark, rows, monkeypatch):
    """Rows of one document in many groups: the same results."""
    monkeypatch.setattr(superkmers, "STRETCH", 4)
    check_bytes(spark, patchwork(11, 30))
    check_words(spark, [(r[0], r[1]) for r in rows])


def test_many_equal_rows(spark):
    """Copies under one id or under none are one document and cost one row."""
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(None, t)] * 300 + [(4, t + " end")] * 200 + [(5, "own")]
    for f, words in ((suffix_array.byte_digest, len(t)), (debruijn.word_digest, 60)):
        got = [(r[0], r[2]) for r in f(spark.createDataFrame(rows, DOC).repartition(3)).collect()]
        assert sorted(got, key=repr) == sorted([(None, 0)] * 300 + [(4, words)] * 200 + [(5, 0)], key=repr)
