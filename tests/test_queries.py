"""Each registered query against its SQL on the small tables."""

import datetime
import math
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from quarry import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def value(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (bool, str, datetime.datetime)) or hasattr(x, "isoformat"):
        return str(x)
    if isinstance(x, Decimal) or hasattr(x, "__float__"):
        return f"{float(x):.6g}" if float(x) != int(float(x)) else str(int(float(x)))
    return str(x)


def rows(df):
    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLE_SQL:
        want = con.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalog.ORACLE_SQL) > 150
    assert entry.entry(spark).count() > 0
