"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import math

import duckdb
import pytest

from tarmac.plans.queries import ORACLE_SQL, QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 7)
    return str(v) if isinstance(v, datetime.date) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    result = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows(columns, result.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_entry_and_registry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
