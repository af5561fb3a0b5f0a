"""Every registered query against its SQL, on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
from conftest import DATA
from webloom.registry import all_queries, all_sql


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    assert ": same, " in compare(spark, con, name, DATA)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
