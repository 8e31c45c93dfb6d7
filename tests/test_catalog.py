import math
import os

import pytest

import __spark_entry__ as entry
from cuewright.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


def rows(records):
    return sorted((tuple(norm(v) for v in r) for r in records), key=repr)


def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck().sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == cols
    order = [want.columns.index(c) for c in cols]
    assert rows(df.select(*cols).collect()) == rows([[r[i] for i in order] for r in want.fetchall()])


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["media_id", "idx", "start", "end", "text", "start_stamp"]
    assert set(catalog.queries()) <= set(entry.queries())
