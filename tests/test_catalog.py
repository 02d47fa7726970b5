"""Every query against its oracle at the smallest scale."""

import os

import duckdb
import pytest

from tessera.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shown(v):
    """A value as text; whole numbers alike, whether pandas holds them as integers or, beside NULLs, as floats."""
    if v is None or v != v:
        return "NULL"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def normal(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(shown, row)) for row in df.where(df.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
