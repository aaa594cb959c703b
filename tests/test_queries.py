"""Every query with SQL must give the same rows as DuckDB on the same tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from redolent.queries import QUERIES, SQL


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, data, name):
    df = QUERIES[name](spark, data)
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(norm(r[columns.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
