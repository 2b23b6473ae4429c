"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if n[:2] in ("q_", "g_", "f_", "l_", "k_", "w_", "v_"))


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return c


def rows(df):
    import pandas as pd

    df = df[sorted(df.columns)].astype(object)
    cell = lambda x: None if x is None or x is pd.NA or x is pd.NaT or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=lambda r: [(x is None, x or "") for x in r])


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    got, want = entry.queries()[name](spark, SMALL).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() == 5
