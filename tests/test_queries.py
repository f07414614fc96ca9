"""Every query of the library against DuckDB on the driver's smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.queries import QUERIES, SQL, flagship

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def cells(df: pd.DataFrame) -> list:
    """Rows as text, numbers rounded, NULLs alike."""

    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "~"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def test_each_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert cells(got) == cells(expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert flagship(spark, DATA).count() == 4
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
