import random

from cuewright.llm import lines

from . import brute


def test_against_loop(docs, rows):
    got = sorted(tuple(r) for r in lines.line_digest(docs).collect())
    want = sorted(brute.lines([(r[0], r[1]) for r in rows]))
    assert got == want and sum(w[2] for w in want) > 10


def test_runs_over_many_tasks(spark, monkeypatch):
    """One line in most documents: its run spans tasks and batches."""
    monkeypatch.setattr(lines, "MAX_HELD", 50)
    monkeypatch.setattr(lines, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16"))
    r = random.Random(1)
    common = ["the line that all of them have in common", "the line that very few of them hold", "and one more that is found in half of all"]
    rows = [(i, "\n".join([f"own line of document {i}"] + [common[0]] * r.randint(0, 2) + ([common[1]] if i in (5, 300) else []) + ([common[2]] if i % 2 else []))) for i in range(400)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        got = sorted(tuple(x) for x in lines.line_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == sorted(brute.lines(rows))


def test_bitmaps(docs, rows):
    from cuewright.llm.common import keyed

    maps = lines.keep_bitmaps(keyed(docs)).collect()
    dropped = {r[0]: r[2] for r in brute.lines([(r[0], r[1]) for r in rows])}
    assert maps and all((~lines.unpack(m._keep, m._upto)).sum() == dropped[m._k] for m in maps)


def test_texts(docs, rows):
    got = {r.doc_id: r.text for r in lines.drop_lines(docs).collect()}
    want = {r[0]: r[3] for r in brute.lines([(r[0], r[1]) for r in rows])}
    assert all(brute.sha(got[d] or "") == s for d, s in want.items())


def test_empty_and_odd(none, odd):
    assert lines.line_digest(none).count() == 0 and lines.drop_lines(none).count() == 0
    got = [tuple(r) for r in lines.line_digest(odd).collect()]
    assert len(got) == 8 and not sum(r[2] for r in got)  # its line is in two documents only
    assert lines.drop_lines(odd).columns == odd.columns


def test_equal_rows_and_long_texts(spark):
    """Very many copies of one row count once; a text of very many lines keeps its own."""
    line = "a line that some documents have in common"
    long = "\n".join([line] + [f"own line number {i} of the long one" for i in range(150_000)] + [line])
    rows = [(None, f"{line}\nx")] * 500 + [(3, f"{line}\ny")] * 200 + [(3, "z")] + [(1, long), (9, line)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped) for r in lines.line_digest(d).collect()), key=repr)
    assert got == sorted([(None, 2, 1)] * 500 + [(3, 2, 1)] * 200 + [(3, 1, 0), (1, 150_002, 2), (9, 1, 0)], key=repr)
    from cuewright.llm.common import keyed, once

    gone = lines.dropped_lines(keyed(d)).collect()
    assert len(gone) == len(set(gone)) == 4
    assert once(keyed(d)).count() == 5
