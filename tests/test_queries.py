"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_same_rows_as_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    theirs = sorted(str([norm(r[columns.index(c)]) for c in order]) for r in found.fetchall())
    assert sorted(str([norm(r[c]) for c in order]) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("p")))
def test_runs_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
