"""Registered queries against their SQL on the smallest test data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import difference, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, connection, name):
    ours = queries()[name](spark, FOLDER).toPandas()
    theirs = connection.execute(oracle_sql()[name]).df()
    assert difference(ours, theirs) is None


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
