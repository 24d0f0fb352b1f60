"""Every registered query of the core library against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import pandas as pd
import pytest

from tidemark.plans.queries import ORACLE_SQL_BY_QUERY, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "NULL"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def _rows(df):
    return sorted(tuple(_text(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE_SQL_BY_QUERY:
        assert len(got) > 0
        return
    want = con.sql(ORACLE_SQL_BY_QUERY[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert _rows(got) == _rows(want)
