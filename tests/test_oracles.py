"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from seatrack.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
NAMES = "region nation customer supplier part orders lineitem events documents labels"


def canon(df):
    df = df[sorted(df.columns)]
    one = lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.5g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in NAMES.split():
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1 and len(__spark_entry__.queries()) > 60
