"""The entry module against SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from leafmill.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, con, name):
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(core.SQL[name])
    at = [x[0] for x in cur.description]
    assert sorted(at) == cols
    assert got == sorted(tuple(str(r[at.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
