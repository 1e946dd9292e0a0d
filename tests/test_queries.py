"""Every named query against its SQL over the same tables, at the smallest scale."""

import os

import duckdb
import pytest

from larkspur.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert rows == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
