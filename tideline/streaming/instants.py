"""From a stream of samples to active alerts: instant values and absence at every evaluation.

An evaluation is made when the watermark passes it, from the last sample of a series within the
lookback, so results do not depend on how the input is cut into micro-batches.  The rows feed
``stream_alerts``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.functions.floats import ieee_compare
from tideline.functions.templates import render_map
from tideline.model import clean_labels, label_key, label_map, labels_of, merge_labels, micros
from tideline.operators.select import Selector, any_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Samples of a key that a task holds before they are appended to its state.
PORTION = 10_000


class TickProcessor(StatefulProcessor):
    """Evaluations ``start + j * step`` of one key, from its samples ``(x, value)``.

    State: samples that no evaluation has passed yet, the last one before, and the last evaluation.
    With ``absent`` it returns the evaluations without a sample within the lookback, from ``start`` on;
    else those with one, and their value.
    """

    def __init__(self, start: int, step: int, lookback: int, absent: bool = False):
        self.start, self.step, self.lookback, self.absent = start, step, lookback, absent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "x long, value double")
        self.run = handle.getValueState("run", "j long, known boolean, x long, value double")

    def _register(self, j: int) -> None:
        self.handle.registerTimer(-(-(self.start + j * self.step) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, points = None, []
        for row in rows:
            points.append((row.x, math.nan if row.value is None else row.value))
            first = row.x if first is None else min(first, row.x)
            if len(points) == PORTION:
                self.waiting.appendList(points)
                points = []
        if points:
            self.waiting.appendList(points)
        if first is not None:
            self._register(0 if self.absent and not self.run.exists() else max(0, -((self.start - first) // self.step)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        final = (timerValues.getCurrentWatermarkInMs() * 1000 - self.start) // self.step
        before = self.run.get()
        j, known, x, value = before or (-1, False, 0, 0.0)
        if j >= final:
            return
        points = sorted(self.waiting.get())
        at, found = 0, []
        while j < final:
            live = known and x >= self.start + (j + 1) * self.step - self.lookback
            if not self.absent and not live:  # go on at the evaluation after the next sample
                if at == len(points):
                    j = final
                    break
                j = max(j, -((self.start - points[at][0]) // self.step) - 1)
                if j >= final:
                    break
            j += 1
            now = self.start + j * self.step
            while at < len(points) and points[at][0] <= now:
                if not known or points[at][0] > x:
                    known, (x, value) = True, points[at]
                at += 1
            if (known and x >= now - self.lookback) != self.absent:
                found.append((now, 1.0 if self.absent else value))
        j = max(j, final)
        if points:
            if at < len(points):
                self.waiting.put(points[at:])
            else:
                self.waiting.clear()
        live = known and x >= self.start + (j + 1) * self.step - self.lookback
        if live or self.absent:
            self.run.update((j, known, x, value))
            self._register(j + 1)
        else:
            if before:
                self.run.clear()
            if at < len(points):
                self._register(-((self.start - points[at][0]) // self.step))
        names = dict(zip(("metric", "series_id"), key, strict=False))
        for us, value in found:
            yield Row(**names, ts=EPOCH + timedelta(microseconds=us), value=None if value != value else value)

    def close(self) -> None:
        pass


def stream_instants(samples: DataFrame, start, step, lookback="5m", lateness: str = "0 seconds") -> DataFrame:
    """Latest sample of each series within the lookback at every ``start + j * step``, as a vector.

    An evaluation is emitted when the watermark (``lateness`` behind the newest sample) passes it.
    A series has one state; quiet series have none.  Needs the RocksDB state store.
    """
    rows = samples.withWatermark("ts", lateness).select(
        F.coalesce("metric", F.lit("")).alias("metric"), "series_id", "ts", F.unix_micros("ts").alias("x"), "value"
    )
    found = rows.groupBy("metric", "series_id").transformWithState(
        TickProcessor(micros(start), micros(step), micros(lookback)),
        "metric string, series_id string, ts timestamp, value double",
        "Append",
        "eventTime",
        eventTimeColumnName="ts",
    )
    return found.select("metric", labels_of("series_id").alias("labels"), "series_id", "ts", "value")


def stream_absent(
    samples: DataFrame, selector: Selector, start, step, lookback="5m", lateness: str = "0 seconds"
) -> DataFrame:
    """1 at every evaluation from ``start`` on without a sample of the selector within the lookback.

    All samples of the stream tell the time.  They are folded to one row per step before they meet,
    so the one key that knows about absence gets a row per step, however many series there are.
    """
    width = micros(step)
    rows = samples.select(
        F.timestamp_micros(F.unix_micros("ts") - 1).alias("at"),  # windows are half open on the right
        F.when(selector.condition(), F.unix_micros("ts")).alias("x"),
    ).withWatermark("at", lateness)
    window = F.window("at", f"{width} microseconds", startTime=f"{micros(start) % width} microseconds")
    steps = rows.groupBy(window.alias("w")).agg(F.max("x").alias("x"))
    # A step without a selected sample still moves the clock; its sample lies before any lookback.
    before = F.lit(micros(start) - (1 << 53))
    ticks = steps.select(
        F.lit("").alias("key"), F.window_time("w").alias("at"), F.coalesce("x", before).alias("x"), F.lit(1.0).alias("value")
    )
    found = ticks.groupBy("key").transformWithState(
        TickProcessor(micros(start), width, micros(lookback), absent=True),
        "metric string, ts timestamp, value double",
        "Append",
        "eventTime",
        eventTimeColumnName="ts",
    )
    labels = label_map({k: F.lit(v) for k, v in selector.equal_labels().items()})
    return found.select(
        F.lit(None).cast("string").alias("metric"), labels.alias("labels"), label_key(labels).alias("series_id"), "ts", "value"
    )


@dataclass(frozen=True)
class GaugeRule:
    """Alert while a gauge compares true with a constant."""

    name: str
    selector: Selector
    op: str
    k: float
    labels: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)

    def active(self) -> Column:
        return self.selector.condition() & ieee_compare(self.op, F.col("value"), F.lit(float(self.k)))

    def instance(self) -> Column:
        added = merge_labels(render_map(self.labels), F.create_map(F.lit("alertname"), F.lit(self.name)))
        labels = clean_labels(merge_labels(F.col("labels"), added))
        return F.struct(F.lit(self.name).alias("alert"), labels.alias("labels"), render_map(self.annotations).alias("annotations"))


def stream_gauge_rules(
    rules: list[GaugeRule], samples: DataFrame, start, step, lookback="5m", lateness: str = "0 seconds"
) -> DataFrame:
    """Active instances of a set of gauge rules, ``(alert, labels, series_id, ts, value, annotations)``.

    All rules read the same instant values, which are formed once.
    """
    picked = samples.filter(any_of(rule.selector for rule in rules))
    now = stream_instants(picked, start, step, lookback, lateness)
    hits = F.filter(F.array(*[F.when(rule.active(), rule.instance()) for rule in rules]), lambda hit: hit.isNotNull())
    active = now.select("ts", "value", F.explode(hits).alias("hit")).select("hit.*", "ts", "value")
    return active.select("alert", "labels", label_key(F.col("labels")).alias("series_id"), "ts", "value", "annotations")


def absent_instances(name: str, absent: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Absence as active instances of an alert."""
    added = label_map({**{k: F.lit(v) for k, v in (labels or {}).items()}, "alertname": F.lit(name)})
    merged = merge_labels(F.col("labels"), added)
    named = absent.select(F.lit(name).alias("alert"), merged.alias("labels"), "ts", "value")
    return named.select("alert", "labels", label_key(F.col("labels")).alias("series_id"), "ts", "value")
