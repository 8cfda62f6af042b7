"""Every registered query equals its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import differences, run_sql

DATA = "/root/testdata/sf0.001"
#: The queries over the star; optional subpackages have tests of their own.
CORE = [q.__name__ for q in entry._QUERIES + entry._SITE_QUERIES]


@pytest.fixture(scope="module")
def sql():
    return entry.oracle_sql()


def test_every_query_has_sql(sql):
    assert set(sql) >= set(CORE)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_its_sql(spark, sql, name):
    columns, rows = run_sql(DATA, sql[name])
    assert differences(entry.queries()[name](spark, DATA), columns, rows) == ""


def test_flagship(spark):
    assert entry.entry(spark).count() == 21
