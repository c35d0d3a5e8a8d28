"""Every registered query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    ref = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(ref.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [list(ref.columns).index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in ref.fetchall()), key=repr)


def test_every_query_has_a_frame(spark):
    assert set(SQL) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
