"""Notification timing of alert groups, in batch.

A group is flushed ``group_wait`` after its first alert and then every
``group_interval``.  A flush notifies when the group changed since the last flush or
when ``repeat_interval`` passed since the last notification; a group without firing
alerts ends at its next flush.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.model import micros

# Executors need no installed copy of this module: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP = ["receiver", "group_key"]
SENT = "receiver string, group_key string, sent_us long, reason string, firing long"


@dataclass(frozen=True)
class Timing:
    group_wait: int = micros("30s")
    group_interval: int = micros("5m")
    repeat_interval: int = micros("12h")
    send_resolved: bool = True


def changes(intervals: DataFrame) -> DataFrame:
    """Alerts that began and ended per group and instant.

    This shrinks a group to at most one row per evaluation instant, however many
    alerts it has, before its timeline is walked in one place.
    """
    cells = F.array(
        F.struct(F.col("fired_at").alias("at"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("resolved_at").alias("at"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )
    rows = intervals.select(*GROUP, F.explode(cells).alias("c")).filter(F.col("c.at").isNotNull())
    return rows.groupBy(*GROUP, F.unix_micros("c.at").alias("at")).agg(
        F.sum("c.up").cast("bigint").alias("up"), F.sum("c.down").cast("bigint").alias("down")
    )


@dataclass
class GroupState:
    """Where a group stands: alerts firing, first planned flush, last flush, last notification."""

    firing: int = 0
    first: int | None = None
    last: int | None = None
    sent: int | None = None


def next_flush(state: GroupState, event: int | None, timing: Timing) -> int | None:
    """Next flush at which something can happen, given the next known event."""
    if state.last is None:
        return state.first
    due = None if state.sent is None else state.sent + timing.repeat_interval
    targets = [x for x in (due, event) if x is not None]
    if not targets:
        return None
    waits = max(1, -(-(min(targets) - state.last) // timing.group_interval))
    return state.last + waits * timing.group_interval


def advance(state: GroupState, events: list[tuple], until: int, timing: Timing):
    """Notifications ``(at, reason, firing)`` up to ``until``, and the events left over.

    ``events`` are ``(at, up, down)`` in time order and hold everything up to ``until``.
    """
    notes, i = [], 0
    while True:
        if state.first is None:
            while i < len(events) and events[i][1] == 0:
                i += 1
            if i == len(events):
                break
            state.first = events[i][0] + timing.group_wait
        tick = next_flush(state, events[i][0] if i < len(events) else None, timing)
        if tick is None or tick > until:
            break
        began = ended = 0
        while i < len(events) and events[i][0] <= tick:
            began, ended = began + events[i][1], ended + events[i][2]
            i += 1
        state.firing += began - ended
        reason = _reason(state, began, ended, tick, timing)
        if reason:
            notes.append((tick, reason, state.firing))
            state.sent = tick
        state.last = tick
        if state.firing == 0:
            state.first = state.last = state.sent = None
    return notes, events[i:]


def _reason(state: GroupState, began: int, ended: int, tick: int, timing: Timing) -> str | None:
    if state.sent is None:
        return "new" if state.firing else None
    if state.firing == 0:
        return "resolved" if timing.send_resolved else None
    if began or (ended and timing.send_resolved):
        return "changed"
    return "repeat" if tick - state.sent >= timing.repeat_interval else None


def schedule_notifications(intervals: DataFrame, end, timing: Timing | None = None) -> DataFrame:
    """Notifications per group for ``(receiver, group_key, fired_at, resolved_at)`` until ``end``."""
    timing, stop = timing or Timing(), micros(end)

    def per_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        events = list(zip(rows["at"].tolist(), rows["up"].tolist(), rows["down"].tolist()))
        notes, _ = advance(GroupState(), events, stop, timing)
        out = [(*key, *note) for note in notes]
        return pd.DataFrame(out, columns=[*GROUP, "sent_us", "reason", "firing"])

    sent = changes(intervals).groupBy(*GROUP).applyInPandas(per_group, SENT)
    return sent.select(
        *GROUP, F.timestamp_micros("sent_us").alias("sent_at"), "reason", "firing"
    )


def write_notifications(notes: DataFrame, path: str) -> None:
    """Write notification rows by receiver and day; a repeated run replaces the days it has."""
    rows = notes.withColumn("date", F.to_date("sent_at"))
    replacing = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    replacing.partitionBy("receiver", "date").parquet(path)
