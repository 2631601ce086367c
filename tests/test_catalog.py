"""Every registered query with SQL gives what DuckDB gives."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tabulon.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())


def matches_sql_over_orders(spark, folder, name, rows):
    """A query's one row against its SQL's, over orders given as SQL."""
    c = duckdb.connect()
    c.execute(f"COPY ({rows}) TO '{folder}/orders.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    cursor = c.execute(catalog.oracle_sql()[name])
    assert catalog.queries()[name](spark, str(folder)).head().asDict() == dict(zip((x[0] for x in cursor.description), cursor.fetchone()))


def test_double_statistics_of_many_distinct_values(spark, tmp_path):
    matches_sql_over_orders(spark, tmp_path, "double_stats", "SELECT i o_orderkey, (i * 7919 % 100103)::double o_totalprice FROM range(150000) r(i)")


def test_numeric_statistics_of_large_amounts(spark, tmp_path):
    matches_sql_over_orders(spark, tmp_path, "column_stats_numeric", "SELECT i o_orderkey, (90000000 + (i * 7919 % 90001) * 37.01)::double o_totalprice FROM range(150000) r(i)")


@pytest.mark.parametrize("name, rows", [("double_stats", "SELECT 1 o_orderkey, -92188.79::double o_totalprice"), ("column_stats_numeric", "SELECT i o_orderkey, CASE i WHEN 0 THEN 170682.12 ELSE 170682.11 END::double o_totalprice FROM range(8) r(i)")])
def test_statistics_round_ties_as_sql_does(spark, tmp_path, name, rows):
    matches_sql_over_orders(spark, tmp_path, name, rows)


def test_rounding_keeps_huge_numbers(spark):
    values = [(1e306,), (-math.inf,), (None,)]
    assert [tuple(r) for r in spark.createDataFrame(values, "x double").select(catalog._round("x", 4)).collect()] == values


def test_entry_imports():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
