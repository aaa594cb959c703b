"""The queries of the training-data operators that SQL can say must give the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from redolent.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, data)
    assert sorted(columns) == sorted(df.columns)
    ours = sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr)
    theirs = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert ours == theirs
