"""Every registered query with SQL gives what DuckDB gives on the smallest data folder."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from veldspar import catalog
from veldspar.session import data_dir

ROOT = data_dir()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(ROOT):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{ROOT}/{f}'")
    return c


def rows(df, columns):
    shown = lambda x: "" if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) else str(x)
    return sorted(tuple(map(shown, r)) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, ROOT).toPandas(), con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, ROOT).count() > 0
