"""Scalar helpers whose semantics differ between SQL dialects.

Times never come from the clock: reports take ``asof`` so that results repeat.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400}


def day_of(asof: datetime) -> date:
    return asof.date()


def query_date(asof: datetime) -> date:
    """Day before the day that contained ``asof`` minus 18 hours."""
    return (asof - timedelta(hours=18)).date() - timedelta(days=1)


def year_before(asof: datetime) -> Column:
    return F.add_months(F.lit(day_of(asof)), -12)


def whole_units(unit: str, later: Column, earlier: Column) -> Column:
    """Whole units elapsed between two instants, truncated towards zero."""
    delta = F.unix_micros(later) - F.unix_micros(earlier)
    return F.call_function("div", delta, F.lit(UNITS[unit] * 1_000_000))


def days_between(later: Column, earlier: Column) -> Column:
    return F.date_diff(later, earlier)


def trunc_to(unit: str, column: Column) -> Column:
    return F.date_trunc(unit, column)


def fmt_date(column: Column, pattern: str) -> Column:
    return F.date_format(column, pattern)


def rx_extract(column: Column, pattern: str, group: int | None = None) -> Column:
    """First match (its first group when there is one), NULL when nothing matches."""
    if group is None:
        group = 1 if "(" in pattern.replace("(?:", "").replace("\\(", "") else 0
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group))


def prefix(column: Column, n: int) -> Column:
    return F.substring(column, 1, n)


def to_int64(column: Column) -> Column:
    """Round half away from zero, then cast."""
    return F.round(column).cast("bigint")


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def node_name(column: Column, machine: str, site: str) -> Column:
    """``machine-site`` from a file name; NULL unless both patterns match."""
    return F.concat(rx_extract(column, machine, 1), F.lit("-"), rx_extract(column, site, 1))
