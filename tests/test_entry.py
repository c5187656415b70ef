import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire import queries as core

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return round(v, 8) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.ORACLE) <= set(core.QUERIES)


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    q = con.execute(core.ORACLE[name])
    cols = [c[0] for c in q.description]
    df = core.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    want = sorted(str(tuple(map(plain, r))) for r in q.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == want
