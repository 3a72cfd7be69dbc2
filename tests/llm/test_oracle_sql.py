"""The queries that SQL can state, against DuckDB."""

import glob
import os

import duckdb
import pytest

from thermolith.llm import queries


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name, size):
    c = duckdb.connect()
    for p in glob.glob(f"/root/testdata/{size}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    theirs = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    want = [tuple(r) for r in theirs.fetchall()]
    got = queries.QUERIES[name](spark, f"/root/testdata/{size}")
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want, key=str)
