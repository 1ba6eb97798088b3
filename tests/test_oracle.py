"""Every registered query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from log_cases import SMALL
from logweave.sources.fixtures import TABLES


def norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = rows(E.queries()[name](spark, SMALL).toPandas())
    want = rows(duck.sql(E.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_runs_and_entry_has_rows(spark):
    assert E.entry(spark).count() > 0
    from logweave.plans.catalog import QUERIES
    assert set(QUERIES) <= set(E.oracle_sql())
