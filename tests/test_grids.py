"""Grids of odd steps read the whole table."""

import pytest

from checks.range_queries import DAY, ODD, SEVEN
from checks.registry import HOURLY, Tables
from tideline.operators.slices import in_reach

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("grid", [ODD, SEVEN], ids=["61s", "7m"])
def test_odd_grids_span_the_table(spark, grid):
    t = Tables(spark, SMALL)
    assert in_reach(t.counter, grid, DAY, 0).count() == in_reach(t.counter, HOURLY, DAY, 0).count() == t.ev.count()
