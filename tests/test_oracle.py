"""Every named query beside its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from shelfmark import suite
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_has_rows(spark):
    assert entry(spark).columns == ["id", "RecordId", "SearchName", "Price", "CategoryIds"]


suite.load_all()


def test_every_query_has_sql():
    assert set(suite.QUERIES) == set(suite.ORACLE)
    assert set(suite.QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    ok, why, _, _ = compare(spark, con, SF, queries()[name], oracle_sql()[name])
    assert ok, why
