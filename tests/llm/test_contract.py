"""Each query over the smallest tables: its columns, their types, a row for each document."""

import os

import pytest

from cuewright.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4": "doc_id bigint, text string, n_found bigint, kinds string",
    "op5": "doc_id bigint, fingerprint string, component_id bigint",
    "op6": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_contract(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    df = queries.queries()[name](spark, DATA)
    types = dict(df.dtypes)
    want = dict(c.split(" ") for c in COLUMNS[name.split("_")[0]].split(", "))
    assert {c: types.get(c) for c in want} == want
    ids = [r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    assert not any(r[c] is None for r in rows for c in want if c != "text")
