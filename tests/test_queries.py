"""Every registered query against its SQL on the smallest tables, and what holds for operators in general."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from tickloom.plans import oracles, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v).removesuffix(" 00:00:00")


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in oracles.ORACLES])
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    want = duck.sql(oracles.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert bag(df.columns, map(tuple, df.collect())) == bag(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in oracles.ORACLES])
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
