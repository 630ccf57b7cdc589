"""Every query with an SQL twin gives the twin's rows."""

import math

import duckdb
import pandas as pd
import pytest

from consentry import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def _rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(_value, r)) for r in frame[names].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, sf, duck, name):
    assert _rows(catalog.queries()[name](spark, sf).toPandas()) == _rows(duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    got = catalog.queries()[name](spark, sf)
    assert got.columns and got.count() > 0
