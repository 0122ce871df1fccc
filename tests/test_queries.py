"""Every query of the library against its SQL in DuckDB, and those without SQL for their stated properties."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from genoloom.plans.catalog import FLAGSHIP, ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("part", "lineitem", "documents"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return "null" if math.isnan(x) else str(int(x)) if x == int(x) else f"{x:.6g}"
    return str(x)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    assert _rows(QUERIES[name](spark, sf_dir).toPandas()) == _rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows and len(set(rows)) == len(rows)


def test_flagship_has_rows(spark, sf_dir):
    assert QUERIES[FLAGSHIP](spark, sf_dir).count() > 0
