"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from siftlake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def shown(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(list(v)) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else str(v)


def rows(df):
    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
