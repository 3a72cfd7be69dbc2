"""Each query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from thermolith import oracles, queries


def cells(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool) or not hasattr(v, "__float__"):
            return str(v)
        return f"{float(v):.6f}"

    columns = sorted(df.columns)
    return sorted(tuple(one(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_oracle_has_a_query():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_rows(spark, folder, duck, name):
    ours = queries.QUERIES[name](spark, folder).toPandas()
    theirs = duck.execute(oracles.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)
