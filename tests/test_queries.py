"""Every registered query against its SQL on the smallest tables; those without SQL must run."""

import math

import duckdb
import pandas as pd
import pytest

from siltstone.plans import registry
from siltstone.plans.model import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, list) or type(v).__name__ == "ndarray":
        return tuple(map(plain, v))
    return float(f"{v:.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df):
    key = lambda r: [(x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in r]
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=key)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, DIR).toPandas()
    if name in registry.oracle_sql():
        want = db.sql(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
