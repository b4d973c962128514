"""Every query against its SQL answer at the smallest scale, and the entry contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from parity.oracles import oracle_sql
from parity.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert check.compare(spark, con, SF, name).startswith("ok ")


def test_every_query_has_an_answer():
    assert set(QUERIES) == set(oracle_sql())
    assert set(QUERIES) <= set(entry.queries()) and set(oracle_sql()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
