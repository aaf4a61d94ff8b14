"""Every query against its SQL on the smallest tables, where they are at hand."""

import glob
import numbers
import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _rows(df):
    own = df[sorted(df.columns)]
    def show(x):
        if pd.isna(x):
            return "-"
        if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)):
            return f"{float(x):.6f}"  # a column of integers with nulls may come as floats
        return str(x)[:10] if hasattr(x, "year") else str(x)

    return sorted(tuple(show(x) for x in r) for r in own.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, sql, name):
    assert _rows(entry.queries()[name](spark, SF).toPandas()) == _rows(sql.sql(entry.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
