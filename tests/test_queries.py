"""Every query with oracle SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from tessera import plans
from tessera.runtime import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, (float, np.floating)) and math.isnan(v):
            return None
        if isinstance(v, (float, np.floating)):
            return f"{v:.9g}"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return str(int(v)) if isinstance(v, (int, np.integer)) else str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(str(plain(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_oracle(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
