"""Every registered query against its SQL restatement on the smallest driver tables."""

import pytest
from oracle_compare import compare, connect

import __spark_entry__ as entry_point
from shrinkwise.plans.oracle import ORACLE
from shrinkwise.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


def test_flagship_runs(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert compare(entry_point.queries()[name](spark, SF_DIR), duck, entry_point.oracle_sql()[name]) == []
