"""Every registered query equals its DuckDB twin on the smallest tables."""

import pytest

from checks import all_queries
from checks.compare import compare, duck

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLE = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    good, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SMALL)
    assert good, note


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
