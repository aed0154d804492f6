"""Evaluation of rules on a grid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.templates import render_map
from tideline.model import COLUMNS, Grid, clean_labels, label_key, merge_labels, micros
from tideline.operators import rangefn, vector
from tideline.operators.select import Selector, any_of
from tideline.shared import stored


class Evaluator:
    """Samples and a grid.  Equal selections share one DataFrame, so Spark reuses exchanges."""

    def __init__(self, samples: DataFrame, grid: Grid, lookback="5m"):
        self.samples, self.grid, self.lookback = samples, grid, lookback
        self._made: dict = {}

    def _once(self, key, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def pick(self, selector: Selector) -> DataFrame:
        return self.samples.filter(selector.condition())

    @property
    def instants(self) -> DataFrame:
        return self._once("instants", lambda: self.grid.instants(self.samples.sparkSession))

    def at(self, selector: Selector, shift=0) -> DataFrame:
        return self._once(
            ("at", selector, shift),
            lambda: rangefn.instant(self.pick(selector), self.grid, self.lookback, shift),
        )

    def increase(self, selector: Selector, d, shift=0, mode="extrapolated") -> DataFrame:
        return self._once(
            ("increase", selector, d, shift, mode),
            lambda: rangefn.increase(self.pick(selector), d, self.grid, shift, mode),
        )

    def rate(self, selector: Selector, d, shift=0) -> DataFrame:
        return self._once(
            ("rate", selector, d, shift),
            lambda: rangefn.rate(self.pick(selector), d, self.grid, shift),
        )

    def irate(self, selector: Selector, d) -> DataFrame:
        return self._once(
            ("irate", selector, d), lambda: rangefn.irate(self.pick(selector), d, self.grid)
        )

    def resets(self, selector: Selector, d) -> DataFrame:
        return self._once(
            ("resets", selector, d), lambda: rangefn.resets(self.pick(selector), d, self.grid)
        )

    def over_time(self, how: str, selector: Selector, d) -> DataFrame:
        return self._once(
            (how, selector, d),
            lambda: rangefn.over_time(self.pick(selector), how, d, self.grid),
        )

    def absent(self, selector: Selector) -> DataFrame:
        return vector.absent_vector(self.at(selector), self.instants, selector.equal_labels())

    def absent_over_time(self, selector: Selector, d) -> DataFrame:
        return vector.absent_over_time(self.samples, selector, d, self.grid)

    def missing(self, v: DataFrame) -> DataFrame:
        """``absent`` of an expression: no labels can be known."""
        return vector.absent_vector(v, self.instants)


class SharedEvaluator(Evaluator):
    """Evaluator of a rule set: samples are scanned once, and instant lookups share one window job.

    The first pass over the expressions only notes their selectors.  Samples that any of them
    selects are then stored, and so is their instant vector, per shift; selections are filters on
    these tables, pruned by metric.
    """

    def __init__(self, samples: DataFrame, grid: Grid, lookback="5m"):
        super().__init__(samples, grid, lookback)
        self.wanted: dict[int, list[Selector]] = {}
        self.picked: list[Selector] = []
        self.noting = True
        self._instant: dict[int, DataFrame] = {}

    def pick(self, selector: Selector) -> DataFrame:
        if self.noting and selector not in self.picked:
            self.picked.append(selector)
        return super().pick(selector)

    def at(self, selector: Selector, shift=0) -> DataFrame:
        off = micros(shift)
        if self.noting:
            self.wanted.setdefault(off, []).append(selector)
            self.pick(selector)
            return rangefn.instant(self.samples.limit(0), self.grid, self.lookback)
        return self._instant[off].filter(selector.condition())

    def absent_over_time(self, selector: Selector, d) -> DataFrame:
        self.pick(selector)
        return super().absent_over_time(selector, d)

    def settle(self) -> None:
        """End of the first pass: store what the expressions need."""
        self.noting, self._made = False, {}
        self.samples = stored(self.samples.filter(any_of(self.picked)), "samples")
        for off, selectors in self.wanted.items():
            found = self.samples.filter(any_of(selectors))
            self._instant[off] = stored(rangefn.instant(found, self.grid, self.lookback, off), "instants")


Expression = Callable[[Evaluator], DataFrame]


def eval_shared(expr: Expression, samples: DataFrame, grid: Grid, lookback="5m") -> DataFrame:
    """One expression that reads several selections, or one of them several times, over one scan."""
    ev = SharedEvaluator(samples, grid, lookback)
    expr(ev)
    ev.settle()
    return expr(ev)


@dataclass(frozen=True)
class RecordingRule:
    name: str
    expr: Expression


@dataclass(frozen=True)
class AlertRule:
    name: str
    expr: Expression
    hold: str = "0s"
    labels: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)


def _evaluated(rules, samples: DataFrame, grid: Grid, lookback, shape) -> DataFrame | None:
    if not rules:
        return None
    ev = SharedEvaluator(samples, grid, lookback)
    for rule in rules:
        rule.expr(ev)
    ev.settle()
    return reduce(DataFrame.unionByName, [shape(rule, ev) for rule in rules])


def record_rules(rules: list[RecordingRule], samples: DataFrame, grid: Grid, lookback="5m") -> DataFrame | None:
    """Series of several recording rules, each under its rule's name."""

    def shape(rule: RecordingRule, ev: Evaluator) -> DataFrame:
        return rule.expr(ev).withColumn("metric", F.lit(rule.name)).select(*COLUMNS)

    return _evaluated(rules, samples, grid, lookback, shape)


def eval_rules(
    rules: list[AlertRule], samples: DataFrame, grid: Grid, lookback="5m", recording: list[RecordingRule] | None = None
) -> DataFrame:
    """Active instances of a whole rule set as one union, tagged by ``alert``.

    Recording rules run first and alert rules may select their series.
    """
    recorded = record_rules(recording or [], samples, grid, lookback)
    if recorded is not None:
        samples = samples.select(*COLUMNS).unionByName(stored(recorded, "recorded"))
    return _evaluated(rules, samples, grid, lookback, eval_rule)


def eval_rule(rule: AlertRule, ev: Evaluator) -> DataFrame:
    """Active alert instances: ``(alert, labels, series_id, ts, value, annotations)``."""
    found = rule.expr(ev)
    added = merge_labels(
        render_map(rule.labels), F.create_map(F.lit("alertname"), F.lit(rule.name))
    )
    labels = clean_labels(merge_labels(F.col("labels"), added))
    shaped = found.select(
        F.lit(rule.name).alias("alert"),
        labels.alias("labels"),
        "ts",
        "value",
        render_map(rule.annotations).alias("annotations"),
    )
    return shaped.withColumn("series_id", label_key(F.col("labels")))
