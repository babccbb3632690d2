"""Every registered query against its SQL; queries without SQL must give rows."""

import os

import pytest

import __spark_entry__ as entry_point
from tests.oracle import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    rows = QUERIES[name](spark, SF_DIR).toArrow()
    if name in ORACLES:
        assert differences(rows, con.sql(ORACLES[name]).to_arrow_table()) is None
    assert rows.num_rows > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).limit(1).count() == 1
