"""Every registered query against its SQL."""

import pytest

from martloom.plans import ORACLE, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], sf_dir) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["bucket", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
