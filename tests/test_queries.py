"""Every registered query against its SQL on the small tables; columns by name, rows in any order."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillon.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    """Columns by name; numbers as floats, all else as text, missing as None; rows sorted."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        try:
            df[c] = df[c].astype(float)
        except (TypeError, ValueError):
            df[c] = [None if x is None or x is pd.NaT or x is pd.NA or x != x else str(x) for x in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    told = duck.sql(SQL[name])
    types = dict(zip(told.columns, map(str, told.types)))
    assert {c: TYPES[t] for c, t in found.dtypes} == types
    a, b = plain(found.toPandas()), plain(told.df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            assert np.allclose(a[c], b[c], rtol=1e-6, atol=2e-6, equal_nan=True), c
        else:
            assert [None if pd.isna(v) else v for v in a[c]] == [None if pd.isna(v) else v for v in b[c]], c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
