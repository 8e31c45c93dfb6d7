import pytest
from pyspark.sql import functions as F

from cuewright.llm import common
from cuewright.llm import decontaminate as dc
from cuewright.llm.common import keyed

from . import brute

ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def items(spark, rows):
    long = [t for _, t, *_ in rows if t and len(t.split()) > 45]
    own = [(i, " ".join(t.upper().split()[3:20])) for i, t in enumerate(long[:6])]
    return [*own, (10, "One two"), (2, "one, TWO!"), (11, None), (12, "..."), (None, "naïve 日本"), (13, "w1"), (100, own[0][1])]


def test_against_loop(spark, docs, rows, items):
    got = dc.contamination(docs, spark.createDataFrame(items, ITEMS)).drop("item_ids")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expect = brute.contamination([(r[0], r[1]) for r in rows], items)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expect)
    assert sum(e[5] for e in expect) > 5


def test_shuffled_windows_give_the_same(spark, docs, rows, items, monkeypatch):
    monkeypatch.setattr(dc.window_hits, "__defaults__", (0,))
    got = dc.contamination(docs, spark.createDataFrame(items, ITEMS)).drop("item_ids")
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.contamination([(r[0], r[1]) for r in rows], items))


def test_modes(spark, items):
    d = spark.createDataFrame([(1, "Say: one, TWO three!", 5), (2, "clean", 6), (3, None, 7)], "doc_id long, text string, len long")
    b = spark.createDataFrame([(1, "one two")], ITEMS)
    assert sorted((r.doc_id, r.len) for r in dc.decontaminate(d, b).collect()) == [(2, 6), (3, 7)]
    assert {r.doc_id: r.text for r in dc.decontaminate(d, b, "span").collect()} == {1: "Say: ,  three!", 2: "clean", 3: None}
    with pytest.raises(ValueError, match="mode"):
        dc.decontaminate(d, b, "x")


def test_empty_and_odd(spark, docs, none, odd):
    no = spark.createDataFrame([], ITEMS)
    assert dc.contamination(none, no).count() == 0
    assert not dc.contamination(docs, no).where("contaminated or n_hit > 0").count()
    some = spark.createDataFrame([(1, "other words"), (1, "other words")], ITEMS)
    got = [(r.doc_id, r.contaminated, r.n_items) for r in dc.contamination(odd, some).collect()]
    assert len(got) == 8 and [x for x in got if x[1]] == [(3, True, 1)]
    assert dc.decontaminate(odd, some).columns == odd.columns


def test_no_python(docs, spark, items):
    plan = dc.contamination(docs, spark.createDataFrame(items, ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_parted_once_and_stay(spark, docs, items, tmp_path):
    """One scan finds the hits of windows of all lengths; a document without hits has no text in an exchange."""
    docs.write.parquet(str(tmp_path / "d"))
    d = keyed(spark.read.parquet(str(tmp_path / "d")).select("doc_id", "text"))
    wins = dc.item_windows(spark.createDataFrame(items, ITEMS)).select("len", "win", "h").distinct()
    assert wins.select("len").distinct().count() > 2
    found = plan_of(dc.window_hits(d, wins))
    assert found.count("FileScan") == 1 and "BroadcastHashJoin" in found
    out = plan_of(dc.contamination(d, spark.createDataFrame(items, ITEMS)))
    assert "Exchange hashpartitioning" not in out and "SortMergeJoin" not in out
    kept = plan_of(dc.decontaminate(d.drop("_k", "_v"), spark.createDataFrame(items, ITEMS)))
    assert "Exchange hashpartitioning" not in kept


def test_more_hits_than_are_sent(docs, spark, rows, items, monkeypatch):
    monkeypatch.setattr(common.sent_if_small, "__defaults__", (None, 0))
    b = spark.createDataFrame(items, ITEMS)
    want = brute.contamination([(r[0], r[1]) for r in rows], items)
    assert sorted(tuple(r) for r in dc.contamination(docs, b).drop("item_ids").collect()) == sorted(want)
    assert sorted(r.doc_id for r in dc.decontaminate(docs, b).collect()) == sorted(w[0] for w in want if not w[5])


def test_very_long_and_repeated(spark):
    w = [f"w{i}" for i in range(200_000)]
    item = " ".join(w[150_000:150_030])
    rows = [(1, " ".join(w)), (None, item), (None, item), (None, "x " + item), (4, item), (4, item), (4, "clean")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, "w7")], ITEMS)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in dc.contamination(d, b).collect()), key=repr)
    assert got == sorted([(1, 200_000, 31, 2), (None, 30, 30, 1), (None, 30, 30, 1), (None, 31, 30, 1), (4, 30, 30, 1), (4, 30, 30, 1), (4, 1, 0, 0)], key=repr)
    assert [tuple(r) for r in dc.decontaminate(d, b).collect()] == [(4, "clean")]
    spans = {(r.doc_id, r.text) for r in dc.decontaminate(d, b, "span").select("doc_id", F.trim("text").alias("text")).where("doc_id is null or doc_id = 4").collect()}
    assert spans == {(None, ""), (None, "x"), (4, ""), (4, "clean")}
