"""Every query with SQL gives DuckDB's rows on the second test set, to twelve digits; every other one runs."""

import datetime
import decimal
import math

import duckdb
import pytest

from tamis import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.12g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.12g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        expected = duck.sql(sql)
        assert sorted(expected.columns) == cols
        at = [expected.columns.index(c) for c in cols]
        assert rows == sorted(tuple(norm(r[i]) for i in at) for r in expected.fetchall())


def test_sql_only_for_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
