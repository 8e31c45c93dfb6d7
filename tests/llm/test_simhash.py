import random

import numpy as np

from cuewright.llm import simhash
from cuewright.llm.components import components

from . import brute


def test_classes_against_loop(docs, rows):
    fps = [brute.fingerprint(t) for _, t, *_ in rows]
    label = brute.linked(fps, [r[0] for r in rows])
    got = sorted(tuple(r) for r in simhash.simhash_classes(docs).collect())
    assert got == sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, label, strict=True))
    assert len(set(label)) < len(label)


def near_points(seed, n):
    r = random.Random(seed)
    pts = [r.getrandbits(64) for _ in range(n // 3)]
    while len(pts) < n:
        p = r.choice(pts[-200:])
        for _ in range(r.randint(1, 5)):
            p ^= 1 << r.randrange(64)
        pts.append(p)
    return np.unique(np.array(pts, np.uint64))


def roots(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_trees_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 64)
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "SAMPLE", 300)
    pts = near_points(1, 2500)
    i, j = np.nonzero(np.bitwise_count(pts[:, None] ^ pts[None, :]) <= 3)
    want = roots(len(pts), zip(i.tolist(), j.tolist(), strict=True))
    at = {int(p): k for k, p in enumerate(pts.view(np.int64))}
    got = simhash.fingerprint_links(spark.createDataFrame([(int(p),) for p in pts.view(np.int64)], "fp long").repartition(5)).collect()
    assert all((int(pts[at[r.a]]) ^ int(pts[at[r.b]])).bit_count() <= 3 for r in got)
    assert roots(len(pts), [(at[r.a], at[r.b]) for r in got]) == want
    assert len(got) < 2 * len(pts)


def test_shard_links_are_a_forest():
    pts = near_points(2, 1200)
    a, b = simhash.links(simhash.halves(pts.view(np.int64))[0], pts)
    assert len(a) < len(pts)


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(90)] + [(7, 7), (5, 4)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    k = {x: i for i, x in enumerate(nodes)}
    want = {nodes[i]: nodes[c] for i, c in enumerate(roots(len(nodes), [(k[a], k[b]) for a, b in edges if a != b]))}
    got = [tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(docs, rows):
    label = brute.linked([brute.fingerprint(t) for _, t, *_ in rows], [r[0] for r in rows])
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(label))


def test_empty_and_odd(none, odd):
    assert simhash.simhash_classes(none).count() == 0 and simhash.one_of_each(none).count() == 0
    got = simhash.simhash_classes(odd).collect()
    assert len(got) == 8 and {r.fingerprint for r in got if r.doc_id == 2} == {"0" * 16}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    out = kept.collect()
    assert len([r for r in out if r.doc_id is None]) == len({r.text for r in out if r.doc_id is None})


def test_every_group_keeps_one_row(spark, odd, rows):
    """Also groups whose smallest doc_id is the same: null ids, and one id with unlike texts."""
    some = [(None if i % 3 == 0 else 5 if i % 3 == 1 else d, t) for i, (d, t, *_) in enumerate(rows)]
    for docs in (odd, spark.createDataFrame(some, "doc_id long, text string").repartition(3)):
        texts = [r.text for r in docs.collect()]
        fps = [brute.fingerprint(t) for t in texts]
        group = dict(zip(texts, brute.linked(fps, fps), strict=True))
        kept = [group[r.text] for r in simhash.one_of_each(docs).collect()]
        assert sorted(kept) == sorted(set(group.values()))


def test_links_of_points_that_a_half_does_not_part():
    """Points with one half in common: the subtree goes on over all 64 bits. Unlike runs of it lose nothing."""
    r = np.random.default_rng(3)
    pts = np.unique(np.concatenate([np.uint64(5 << 32) | r.integers(0, 2**12, 1500, np.uint64), r.integers(0, 2**64, 300, np.uint64)]))
    i, j = np.nonzero(np.bitwise_count(pts[:, None] ^ pts[None, :]) <= 3)
    want = roots(len(pts), zip(i.tolist(), j.tolist(), strict=True))
    got = []
    for half in simhash.halves(pts.view(np.int64)):
        a, b = simhash.links(half, pts)
        assert (np.bitwise_count(pts[a] ^ pts[b]) <= 3).all() and len(a) < len(pts)
        got += zip(a.tolist(), b.tolist(), strict=True)
    assert roots(len(pts), got) == want


def test_linking_is_not_quadratic():
    import time

    r = np.random.default_rng(1)
    took = {}
    for n in (32_000, 128_000):
        pts = np.unique(r.integers(0, 2**64, n, np.uint64))
        began = time.process_time()
        simhash.links(simhash.halves(pts.view(np.int64))[0], pts)
        took[n] = time.process_time() - began
    assert took[128_000] < 12 * max(took[32_000], 0.1)  # 16 times would be quadratic


def test_a_long_chain(spark):
    n = 3000
    edges = [(i, i + 1) for i in range(n)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == dict.fromkeys(range(n + 1), 0)


def test_a_very_long_text(spark):
    t = " ".join(f"w{i % 977}" for i in range(300_000))
    d = spark.createDataFrame([(1, t), (2, t), (3, "w")], "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_classes(d).collect()}
    assert got[1] == got[2] and got[1][1] == 1 and got[3][1] == 3
