"""Every core query with SQL gives the rows DuckDB gives."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from coverline import queries as core

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, duck, name):
    got = core.queries()[name](spark, small)
    want = duck.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    rows = lambda rs, at: Counter(tuple(str(r[at(c)]) for c in sorted(cols)) for r in rs)
    assert rows(want.fetchall(), cols.index) == rows(got.collect(), lambda c: c)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
