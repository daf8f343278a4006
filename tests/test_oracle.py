"""Each registered query gives the rows of its SQL."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, connection, name):
    assert oracle.compare(spark, connection, SF_DIR, entry.queries()[name], SQL[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
