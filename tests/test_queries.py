"""Every named query against DuckDB on the smallest tables; those beyond SQL return rows."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from veritrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _say(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    if isinstance(v, float) or type(v).__name__ in ("float64", "Decimal"):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.SQL:
        assert len(got) >= 0 and len(got.columns)
        return
    want = con.sql(registry.SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda d: sorted(tuple(_say(v) for v in r) for r in d[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
