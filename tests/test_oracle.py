"""Registered queries against their DuckDB oracle at sf0.001 (the driver
runs the full set at sf0.01 with tools/oracle_check.py semantics)."""

import duckdb
import pytest

import __spark_entry__ as E
from addrgrid.plans.catalog import QUERIES
from addrgrid.plans.oracle import ORACLE
from addrgrid.sources.tables import DRIVER_TABLES
from tools.oracle_check import rows_duck, rows_spark

from conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sc, sr = rows_spark(E.queries()[name](spark, SF))
    dc, dr = rows_duck(con, E.oracle_sql()[name])
    assert sc == dc
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 150
