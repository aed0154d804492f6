"""Series selection, label matchers and warehouse predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.model import label


@dataclass(frozen=True)
class Matcher:
    """One label condition; equality matchers also name the labels of an absent series."""

    name: str
    op: str
    value: str

    def condition(self) -> Column:
        actual = label(self.name)
        if self.op == "=":
            return actual == self.value
        if self.op == "!=":
            return actual != self.value
        matched = actual.rlike(anchored(self.value))
        return matched if self.op == "=~" else ~matched


def anchored(pattern: str) -> str:
    """Regex that must match the whole text."""
    return rf"^(?:{pattern})\z"


def eq(name: str, value: str) -> Matcher:
    return Matcher(name, "=", value)


def ne(name: str, value: str) -> Matcher:
    return Matcher(name, "!=", value)


def rx(name: str, pattern: str) -> Matcher:
    return Matcher(name, "=~", pattern)


def nrx(name: str, pattern: str) -> Matcher:
    return Matcher(name, "!~", pattern)


@dataclass(frozen=True)
class Selector:
    """A metric name with label matchers, usable on any vector."""

    metric: str | None
    matchers: tuple[Matcher, ...] = ()

    def condition(self) -> Column:
        parts = [m.condition() for m in self.matchers]
        if self.metric is not None:
            parts.insert(0, F.col("metric") == self.metric)
        cond = F.lit(True)
        for part in parts:
            cond = cond & part
        return cond

    def equal_labels(self) -> dict[str, str]:
        """Labels fixed by equality; a label that is also matched otherwise is left out."""
        seen: dict[str, list[Matcher]] = {}
        for matcher in self.matchers:
            seen.setdefault(matcher.name, []).append(matcher)
        return {
            name: found[0].value
            for name, found in seen.items()
            if len(found) == 1 and found[0].op == "=" and found[0].value and name != "__name__"
        }


def sel(metric: str | None, *matchers: Matcher) -> Selector:
    return Selector(metric, tuple(matchers))


def select(v: DataFrame, metric: str | Selector | None, *matchers: Matcher) -> DataFrame:
    selector = metric if isinstance(metric, Selector) else sel(metric, *matchers)
    return v.filter(selector.condition())


def any_of(selectors: Iterable[Selector]) -> Column:
    cond = F.lit(False)
    for selector in selectors:
        cond = cond | selector.condition()
    return cond


def var_regex(values: str | list[str] | None) -> str:
    """Regex of a panel variable: one value, several values, or everything."""
    if values is None:
        return ".*"
    chosen = [values] if isinstance(values, str) else values
    return "|".join(re.escape(v) for v in chosen)


def time_range(df: DataFrame, column: str, from_ms: int, to_ms: int) -> DataFrame:
    low, high = F.timestamp_millis(F.lit(from_ms)), F.timestamp_millis(F.lit(to_ms))
    return df.filter(F.col(column).between(low, high))


def date_window(df: DataFrame, column: str, asof: date, first: int, last: int = 0) -> DataFrame:
    """Dates from ``asof - first`` to ``asof - last`` days, as literals so partitions prune."""
    low, high = asof - timedelta(days=first), asof - timedelta(days=last)
    return df.filter(F.col(column).between(F.lit(low), F.lit(high)))


def lag_slice(df: DataFrame, column: str, asof, older: timedelta, newer: timedelta) -> DataFrame:
    """Half-open slice ``(asof - older, asof - newer]``."""
    return df.filter((F.col(column) > F.lit(asof - older)) & (F.col(column) <= F.lit(asof - newer)))


def maybe(param, condition: Column) -> Column:
    """The condition, or true when the parameter is 0 or unset."""
    return condition if param else F.lit(True)


def period_of(column: Column, asof: date) -> Column:
    """Disjoint billing periods; the first that fits wins."""
    day = F.to_date(column)
    return (
        F.when(day == F.lit(asof), "today")
        .when(day == F.lit(asof - timedelta(days=1)), "yesterday")
        .when(day == F.lit(asof - timedelta(days=2)), "before_yesterday")
        .when(day <= F.lit(asof), "month")
    )


def tag(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(column, F.lit(name))


def choose(mode: str, pdf: Column, cdf: Column) -> Column:
    return pdf if mode == "pdf" else cdf


def same_field(a: Column, b: Column, *required: Column) -> Column:
    """Equality of two fields with every required field present."""
    cond = a == b
    for column in required:
        cond = cond & column.isNotNull()
    return cond
