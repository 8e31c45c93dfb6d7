from cuewright.llm import quality

from . import brute

PROSE = "In the morning the people of the town went to the river to look for the boats that had come down in the night with corn and oil. They found none, and so they sat on the stones and told each other what they had heard from those who live further up, where the hills begin.\nLater a boy ran up and said that he had seen a sail."


def test_base_against_loop(docs, rows):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs).collect()}
    for d, t, *_ in rows:
        n = brute.quality_base(t)
        assert got[d] == (*n, n[0] < 50 or 100 * n[4] > 50 * n[0]), d


def test_verdicts(spark):
    texts = {1: PROSE, 2: "buy now " * 40, 3: " | ".join(["cell"] * 30 + ["and the"] * 20), 4: "\n".join([PROSE[:120]] * 2 + ["x the of " * 3] * 6), 5: " ".join(f"{i}" for i in range(80)), 6: " ".join(f"word{i}" for i in range(80)), 7: None, 8: ""}
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].failed_rules == ""
    assert not any(got[i].kept for i in range(2, 9))
    assert "alphabetic" in got[5].failed_rules and "stop_words" in got[6].failed_rules and "symbols" in got[3].failed_rules
    assert got[7].n_words == got[8].n_words == 0 and got[7].base_failed


def test_one_projection(docs):
    plan = quality.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Exchange RoundRobin", "").replace("REPARTITION_BY_NUM", "") or plan.count("Exchange") == 1  # the fixture's own
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_odd(none, odd):
    assert quality.quality_rules(none).count() == 0
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.quality_rules(odd).count() == 8


def test_own_columns_and_long_texts(spark):
    """Columns named like the operator's inner ones stay; a very long text is measured whole."""
    long = " ".join(f"word{i} of the" for i in range(120_000)) + " $"
    d = spark.createDataFrame([(1, PROSE, "u", 5, "n"), (2, long, "v", 6, "m")], "doc_id long, text string, _w string, _n_lines int, n_words string")
    out = quality.quality_rules(d)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1]._w == "u" and got[2]._n_lines == 6 and got[2].n_words == 360_001 and got[2].n_symbols == 1
    assert out.columns.count("n_words") == 1 and out.columns[:4] == ["doc_id", "text", "_w", "_n_lines"]
    kept = quality.keep_good(d)
    assert kept.columns == d.columns and kept.where("doc_id = 1").first().n_words == "n"
