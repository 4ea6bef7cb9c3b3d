"""Every registered policy query against DuckDB on the small tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from veilframe.plans.queries import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if "bool" in type(v).__name__:
        return str(bool(v))
    if "int" in type(v).__name__:
        return str(int(v))
    return repr(round(float(v), 6)) if "float" in type(v).__name__ else str(v)


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(norm, r)) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE:
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
        assert table(got) == table(c.execute(ORACLE[name]).df())
