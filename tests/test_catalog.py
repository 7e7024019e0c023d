"""Every query with SQL gives the same rows in the other engine, on the smallest tables; the rest at least run."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from deedloom.plans import catalog


@pytest.fixture(scope="module")
def other(small):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for name in os.listdir(small):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{small}/{name}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, small, other, name):
    df = entry.queries()[name](spark, small)
    rows, columns = df.collect(), sorted(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql:
        r = other.execute(sql)
        names = [x[0] for x in r.description]
        assert sorted(names) == columns
        want = Counter(tuple(norm(x[names.index(c)]) for c in columns) for x in r.fetchall())
        assert Counter(tuple(norm(x[c]) for c in columns) for x in rows) == want


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark, small):
    plan = catalog.QUERIES["doc_cache_key"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "author" not in plan and "ReadSchema" in plan
