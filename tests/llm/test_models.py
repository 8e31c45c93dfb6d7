import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from cuewright.llm import labelled, quality_model, toxicity

DOC = "doc_id long, text string"
LAB = "doc_id long, quality int, toxic int"


def corpus(n=700):
    r = random.Random(3)
    vocab = [a + b for a in ("ka", "lo", "mi", "ter", "su", "re") for b in ("na", "to", "ri", "sen", "da", "we", "lu")] + ["the", "of", "and", "to"] * 8
    bad = ["zorgic", "blathead", "frunkly"]
    docs, labels = [], []
    for i in range(n):
        toxic, good = r.random() < 0.25, r.random() < 0.75
        w = [r.choice(vocab) for _ in range(r.randint(8, 200))]
        if not good:
            w = [r.choice(w)] * 5 + [f"{x}{r.choice(['###', '$$$', '!!'])}" for x in w]
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(bad).capitalize() + r.choice(["", "!", "."]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def accuracy(rows, labels, col):
    y = {r[0]: r[col] for r in labels}
    held = [r for r in rows if r.held_out and r.doc_id in y]
    return np.mean([r.predicted == y[r.doc_id] for r in held]), len(held)


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    more = [(10_000, None), (10_001, ""), (None, "the of"), (10_002, "... !!"), (5, docs[5][1])]
    return spark.createDataFrame([*docs, *more], DOC).repartition(3), spark.createDataFrame([*labels, (5, 1, 1), (99_999, 0, 1), (None, 1, 1), (7, None, None)], LAB), labels


def test_quality(tables):
    docs, lab, labels = tables
    rows = quality_model.score_quality(docs, lab).collect()
    acc, n = accuracy(rows, labels, 1)
    assert acc > 0.95 and n > 100 and len(rows) == 705
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (10_000, 10_001)}) == 1


def test_toxicity(tables):
    docs, lab, labels = tables
    rows = toxicity.score_toxicity(docs, lab).collect()
    acc, n = accuracy(rows, labels, 2)
    assert acc > 0.93 and n > 100 and len(rows) == 705
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (10_000, 10_001, 10_002)}) == 1


def test_no_labels_or_one_kind(spark, none, docs):
    no = spark.createDataFrame([], LAB)
    one = spark.createDataFrame([(i, 1, 0) for i in range(0, 1000)], LAB)
    for f in (quality_model.score_quality, toxicity.score_toxicity):
        assert f(none, no).count() == 0
        assert {r.score for r in f(docs, no).collect()} == {0.5}
    assert {r.predicted for r in quality_model.score_quality(docs, one).collect()} == {1}
    assert {r.predicted for r in toxicity.score_toxicity(docs, one).collect()} == {0}


def test_windows_cover_all_words():
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(k)).encode() for k in (0, 1, 47, 48, 49, 84, 85, 500)]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    t = toxicity.Tokens(np.frombuffer(b"".join(texts), np.uint8), offsets)
    ids, size, row = t.windows()
    assert [int(x) for x in np.diff(t.at)] == [0, 1, 47, 48, 49, 84, 85, 500]
    for k in range(len(texts)):
        mine = np.flatnonzero(row == k)
        seen = set()
        for turn, w in enumerate(mine):
            seen.update(range(turn * toxicity.STRIDE, turn * toxicity.STRIDE + size[w]))
            assert (ids[w][: size[w]] == t.ids[t.at[k] + turn * toxicity.STRIDE :][: size[w]]).all()
        assert seen == set(range(t.at[k + 1] - t.at[k]))


def test_gradients():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [b"you are a foul thing and this is so", b"good day to all of them " * 9, b"abc"]
    t = toxicity.Tokens(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(x) for x in texts])))
    ids, size, _ = t.windows()
    by = np.argsort(-size, kind="stable")
    ids, size = ids[by], size[by]
    g = np.linspace(0.5, 1.5, len(size))
    f = lambda keep=None: (net.window_logits(net.words_in(t), ids, size, keep) * g).sum()
    keep = {}
    f(keep)
    for name, grad in net.gradients(t, net.words_in(t), ids, size, keep, g).items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        net.p[name][at] += 1e-3
        up = f()
        net.p[name][at] -= 2e-3
        down = f()
        net.p[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - grad[at]) < 1e-3 * max(1, abs(grad[at]))


def test_a_text_scores_alike_alone_and_among_others():
    docs, labels = corpus(150)
    net = toxicity.Network()
    net.fit([t.encode() for _, t in docs], np.array([r[2] for r in labels], float))
    texts = [t.encode() for _, t in docs]
    together = net.score(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(x) for x in texts])))
    for i in (0, 7, 100):
        assert abs(net.score(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))[0] - together[i]) < 1e-4


def test_sample_says_what_its_rows_stand_for(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(400)], DOC)
    labels = spark.createDataFrame([(i, int(i >= 300), 0) for i in range(400)], LAB)
    for most, longest in (({0: 30, 1: 50}, None), ({0: 400, 1: 400}, None), ({0: 400, 1: 60}, 3)):
        some, counts = labelled.sample(docs, labels, "quality", F.lit(True), most, longest)
        assert counts == {0: 300, 1: 100}
        y = np.array([r.y for r in some.collect()])
        weights = labelled.stands_for(y, counts)
        assert [round((y == k).sum() * weights[k]) for k in (0, 1)] == [300, 100]


def test_labels_without_documents_do_not_use_up_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad ### here") for i in range(200)], DOC)
    labels = spark.range(50_000).selectExpr("id - 25000 as doc_id", "cast(id % 2 as int) as quality", "cast(id % 2 as int) as toxic")
    monkeypatch.setattr(quality_model, "SAMPLE", {0: 500, 1: 500})
    some, counts = labelled.sample(docs, labels, "quality", F.lit(True), quality_model.SAMPLE)
    assert some.count() == 200 and counts == {0: 100, 1: 100}
    assert len({r.predicted for r in quality_model.score_quality(docs, labels).collect()}) == 2


def test_very_long_texts(spark, tables):
    """A long text is scored whole: what makes it toxic may be anywhere. It is neither learnt from nor in the way."""
    docs, lab, labels = tables
    clean = " ".join(f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("na", "to", "ri")) + " "
    long = spark.createDataFrame([(20_000, clean * 20_000), (20_001, clean * 15_000 + "Zorgic blathead! frunkly " + clean * 5_000), (20_002, "a" * 1_000_000)], DOC)
    more = spark.createDataFrame([(20_000, 1, 0), (20_002, 0, 0)], LAB)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.unionByName(long), lab.unionByName(more)).collect()}
    assert got[20_001].score > got[20_000].score and len(got) >= 703
    assert {20_000, 20_001, 20_002} <= {r.doc_id for r in quality_model.score_quality(docs.unionByName(long), lab).collect()}


def test_scores_keep_the_share_of_labels():
    """As many rows of either label, but one in ten is the share: the mean score says so, whatever the sample."""
    r = np.random.default_rng(1)
    y = np.repeat([0.0, 1.0], 1500)
    z = r.normal(y * 1.5, 1)
    share = np.where(y == 1, 1, 9)
    x = np.zeros((len(y), quality_model.FEATURES))
    x[:, 0] = z
    good = quality_model.Network(x, y, weights={0: 9.0, 1: 1.0})
    assert abs(np.average(good.score(x), weights=share) - 0.1) < 0.03
    net = toxicity.Network()
    net.logits = lambda data, offsets: z
    net.calibrate([b""] * len(y), y, [], np.zeros(0), share)
    assert abs(np.average(toxicity.sigmoid(net.scale * z + net.shift), weights=share) - 0.1) < 0.02


def test_bounds_do_not_move_the_scores(spark, monkeypatch):
    docs, labels = corpus(500)
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame([(i, int(i % 8 > 0), 0) for i, *_ in labels], LAB)
    monkeypatch.setattr(quality_model, "SAMPLE", {0: 40, 1: 40})  # labels that texts say nothing about: 7 of 8 are good
    assert np.mean([r.score for r in quality_model.score_quality(d, lab).collect()]) > 0.7


def auc(rows, y):
    """Held-out rows' share of pairs in the right order; half for ties."""
    held = [(r.score, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    score, want = np.array([s for s, _ in held]), np.array([k for _, k in held])
    _, rank, n = np.unique(score, return_inverse=True, return_counts=True)
    mid = np.cumsum(n) - (n - 1) / 2
    ones = want.sum()
    return (mid[rank][want == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(want) - ones)), len(held)


@pytest.mark.parametrize(("name", "label", "least"), [("op6_toxicity", "toxic", 0.95), ("op9_quality_model", "quality", 0.97)])
def test_held_out_order(spark, name, label, least):
    import os

    from cuewright.llm import queries

    data = "/root/testdata/sf0.1"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r[label] is not None}
    got, n = auc(queries.queries()[name](spark, data).collect(), y)
    assert n > 500 and got >= least
