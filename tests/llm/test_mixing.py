from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from cuewright.llm import mixing

from .conftest import SCHEMA


def test_targets():
    assert mixing.targets([100, 100, 100]) == [Fraction(300 * 5, 8), Fraction(300 * 2, 8), Fraction(300, 8)]
    t = mixing.targets([10, 1000, 90])
    assert t[0] == 30 and t[2] == 270 and t[1] == 800 and sum(t) == 1100
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == [] and mixing.targets([7]) == [7]
    assert mixing.targets([1, 0, 100]) == [3, 0, 98]


def test_tree():
    q = np.array([100, 7, 0, 33])
    a = mixing.split_tree(q, 9)
    assert (a.sum(axis=0) == q).all() and a.sum(axis=1).max() - a.sum(axis=1).min() <= 1
    assert (a == mixing.split_tree(q, 9)).all() and (a >= 0).all()
    many = np.array([mixing.split_tree(np.array([30, 30]), 2, seed)[0, 0] for seed in range(400)])
    assert abs(many.mean() - 15) < 0.5 and abs(many.var() - 30 * 0.25 * (30 / 59)) < 1  # the hypergeometric's


def corpus(spark, n=3000):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 97)), "en", ["a", "b", "c", None, "B"][0 if i % 3 else i % 5], 0) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "en", "a", 0), (n + 1, " ", "en", "z", 0)], SCHEMA)


def test_counts(spark):
    d = corpus(spark)
    got = mixing.mix_counts(d)
    rows = got.collect()
    by = {r.source: r for r in got.join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("size").alias("size"), F.first("source_size").alias("ss"), F.first("target").alias("t"), F.sum("taken").alias("k")).collect()}
    names = sorted((s for s in by if s is not None)) + [None]
    for s, t in zip(names, mixing.targets([by[s].size for s in names]), strict=True):
        assert by[s].ss == by[s].size and abs(by[s].t - float(t)) < 1e-6
        assert abs(by[s].k - by[s].t) <= 60
    assert all(0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in rows) and len(rows) == 3002
    again = mixing.mix_counts(d.repartition(7))
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in again.collect())


def test_mix_is_the_counts(spark):
    d = corpus(spark, 600).withColumn("Copy", F.lit("own"))
    taken = {r.doc_id: r.taken for r in mixing.mix_counts(d).collect()}
    out = mixing.mix(d).collect()
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + len((r.text or "").split())
    assert got == {k: v for k, v in taken.items() if v or k in got}
    assert len({(r.doc_id, r["copy_"]) for r in out}) == len(out) and {r["Copy"] for r in out} == {"own"}


def test_empty_and_odd(none, odd):
    assert mixing.mix_counts(none).count() == 0 and mixing.mix(none).count() == 0
    got = mixing.mix_counts(odd).collect()
    assert len(got) == 8 and len({(r.size, r.taken) for r in got if r.doc_id == 1 and r.size == 23}) <= 1
    out = mixing.mix(odd)
    assert out.columns == [*odd.columns, "shard_", "copy_"] and {(r["shard"], r["copy"]) for r in out.collect()} <= {("u", 2)}


def near_targets(rows, sources, slack):
    """The contract, by a loop: sizes, source sizes, targets, taken words near them, no document above 3 times its size."""
    size = {}
    for s, n in sources:
        size[s] = size.get(s, 0) + n
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    want = dict(zip(names, mixing.targets([size[s] for s in names]), strict=True))
    taken = dict.fromkeys(names, 0)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - float(want[r.source])) <= 1e-9 * float(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= slack, (s, taken[s], float(want[s]))


def with_source(d, got):
    """Counts joined to sources by what a row of ``d`` has of its own: here the id tells the source."""
    return [r for r in got.join(d.select("doc_id", "source").distinct(), got.doc_id.eqNullSafe(d.doc_id)).select(got["*"], "source").collect()]


def test_repeated_rows_reach_their_targets(spark):
    """100 rows alike in all (null id), 60 alike under one id, and others."""
    rows = [(None, "w " * 10, "en", "a", 1)] * 100 + [(7, "w " * 9, "en", "b", 1)] * 60 + [(100 + i, "w " * (5 + i % 7), "en", "c", 1) for i in range(200)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix_counts(d)
    assert got.count() == 360
    near_targets(with_source(d, got), [(r[3], len(r[1].split())) for r in rows], 6)
    out = mixing.mix(d).collect()
    words = {s: sum(len(r.text.split()) for r in out if r.source == s) for s in "abc"}
    counts = {}
    for r in with_source(d, got):
        counts[r.source] = counts.get(r.source, 0) + r.taken
    assert words == counts
    again = mixing.mix_counts(d.repartition(2))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, again.collect()))


def test_rows_alike_but_for_other_columns(spark):
    rows = [(None, "w " * 10, "en", "a", i) for i in range(50)] + [(i, "w " * 10, "en", "b", 1) for i in range(1000)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("m", F.create_map(F.lit("k"), F.col("n_chars")))
    out = mixing.mix(d).collect()
    per = {}
    for r in out:
        if r.source == "a":
            assert r.m == {"k": r.n_chars}
            per[r.n_chars] = per.get(r.n_chars, 0) + 1
    assert sum(per.values()) == 150 and set(per.values()) == {3}  # its target is above three times its size
    light = spark.createDataFrame([(i, "w " * 10, "en", "0", 1) for i in range(1000)], SCHEMA).withColumn("m", F.create_map(F.lit("k"), F.lit(1).cast("bigint")))
    both = mixing.mix(d.where("source = 'a'").withColumn("source", F.lit("z")).unionByName(light)).collect()
    assert sum(r.source == "z" for r in both) == 150
    third = mixing.mix(d.where("source = 'a'").unionByName(d.where("source = 'b'").limit(25))).collect()
    n = sum(r.source == "a" for r in third)
    assert abs(n - 75 * 5 / 7) <= 1  # 50 rows and some of them once more: a cut among rows that differ in other columns only


def test_more_sources_than_the_driver_takes(spark, monkeypatch):
    rows = [(i, "w " * (1 + i * 31 % 23), "en", f"s{i * i % 97:02}" if i % 9 else None, 0) for i in range(2500)] + [(5000, None, "en", "s00", 0)] + [(6000, "w w w", "en", "tiny", 0)] * 7
    d = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sources = [(r[3], len((r[1] or "").split())) for r in rows]
    plain = mixing.mix_counts(d).collect()
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    got = mixing.mix_counts(d)
    near_targets(with_source(d, got), sources, 23)
    key = lambda rs: sorted((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in rs)
    assert key(got.collect()) == key(plain)
    out = mixing.mix(d).collect()
    assert sum(len((r.text or "").split()) for r in out) == sum(r.taken for r in got.collect())


def test_seventy_thousand_sources(spark):
    d = spark.range(140_000).selectExpr("id as doc_id", "repeat('w ', 1 + cast(id % 5 as int)) as text", "concat('s', id div 2) as source")
    got = mixing.mix_counts(d)
    r = got.selectExpr("sum(size) as n", "sum(taken) as k", "count(*) as c", "max(taken / size) as most").first()
    assert r.c == 140_000 and r.most <= 3 and abs(r.k - r.n) < 0.02 * r.n
