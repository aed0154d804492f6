"""Alert states and notifications over streams.

Rows are kept until the watermark passes them and are then taken in time order, so
the events do not depend on how the input is cut into micro-batches.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.model import micros
from tideline.plans.notify import GROUP, GroupState, Timing, advance, next_flush

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENTS = "alert string, series_id string, event string, at_ms long, since_ms long"
NOTES = "receiver string, group_key string, sent_ms long, reason string, firing long"


class HoldProcessor(StatefulProcessor):
    """Pending, firing and resolved events of one alert instance."""

    def __init__(self, hold_ms: int, step_ms: int):
        self.hold_ms, self.step_ms = hold_ms, step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "since long, last long, fired boolean")
        self.waiting = handle.getListState("waiting", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = {row[0] for row in self.waiting.get()}
        new = sorted({row.at_ms for row in rows} - known)
        if new:
            self.waiting.appendList([(at,) for at in new])
            # One timer for all that waits: it takes whatever is due and registers the next.
            if not known or new[0] < min(known):
                self.handle.registerTimer(new[0])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(row[0] for row in self.waiting.get())
        due = [at for at in waiting if at <= now]
        before = self.run.get()
        since, last, fired = before or (None, None, False)
        out = []
        for at in due:
            if last is not None and at <= last:
                continue
            if last is not None and at - last > self.step_ms:
                if fired:
                    out.append((*key, "resolved", last + self.step_ms, since))
                since = None
            if since is None:
                since, fired = at, False
                if self.hold_ms > 0:
                    out.append((*key, "pending", at, since))
            last = at
            if not fired and at - since >= self.hold_ms:
                fired = True
                out.append((*key, "firing", at, since))
        if last is not None and last + self.step_ms < now:
            if fired:
                out.append((*key, "resolved", last + self.step_ms, since))
            since = last = None
        left = waiting[len(due) :]
        if due:
            self.waiting.put([(at,) for at in left]) if left else self.waiting.clear()
        if last is None:
            if before:
                self.run.clear()
        else:
            self.run.update((since, last, fired))
        ends = [] if last is None else [last + self.step_ms + 1]
        if left or ends:
            self.handle.registerTimer(min(left[:1] + ends))
        for event in out:
            yield Row(**dict(zip(("alert", "series_id", "event", "at_ms", "since_ms"), event, strict=True)))

    def close(self) -> None:
        pass


def stream_alerts(active: DataFrame, hold, step, lateness: str = "0 seconds") -> DataFrame:
    """Events of a stream of active evaluations ``(alert, series_id, ts)``.

    ``lateness`` is how long rows are waited for; rows that come from a stream with a watermark of
    its own, as evaluations of ``streaming.instants``, keep that.  Needs the RocksDB state store.
    """
    marked = "spark.watermarkDelayMs" in active.schema["ts"].metadata
    rows = (active if marked else active.withWatermark("ts", lateness)).select(
        "alert", "series_id", "ts", F.unix_millis("ts").alias("at_ms")
    )
    events = rows.groupBy("alert", "series_id").transformWithState(
        HoldProcessor(micros(hold) // 1000, micros(step) // 1000), EVENTS, "Append", "eventTime"
    )
    return events.select(
        "alert",
        "series_id",
        "event",
        F.timestamp_millis("at_ms").alias("at"),
        F.timestamp_millis("since_ms").alias("since"),
    )


class NotifyProcessor(StatefulProcessor):
    """Notifications of one group, timed as in the batch plan."""

    def __init__(self, timing: Timing):
        self.timing = timing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("group", "firing long, first long, last long, sent long")
        self.waiting = handle.getListState("waiting", "at long, up long, down long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            summed = frame.groupby("at_us")[["up", "down"]].sum()
            for at, up, down in summed.itertuples():
                self.waiting.appendValue((int(at), int(up), int(down)))
                self.handle.registerTimer(-(-int(at) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        merged: dict[int, list[int]] = {}
        for at, up, down in self.waiting.get():
            cell = merged.setdefault(at, [0, 0])
            cell[0], cell[1] = cell[0] + up, cell[1] + down
        events = [(at, *merged[at]) for at in sorted(merged)]
        due = [e for e in events if e[0] <= now]
        state = GroupState(*self.group.get()) if self.group.exists() else GroupState()
        notes, left = advance(state, due, now, self.timing)
        left = left + [e for e in events if e[0] > now]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if state.first is None and state.firing == 0:
            self.group.clear()
        else:
            self.group.update((state.firing, state.first, state.last, state.sent))
            tick = next_flush(state, left[0][0] if left else None, self.timing)
            if tick is not None:
                self.handle.registerTimer(-(-tick // 1000))
        if notes:
            yield pd.DataFrame(
                [(*key, *note) for note in notes], columns=[*GROUP, "sent_us", "reason", "firing"]
            ).assign(sent_ms=lambda d: d["sent_us"] // 1000)[
                ["receiver", "group_key", "sent_ms", "reason", "firing"]
            ]

    def close(self) -> None:
        pass


def stream_notifications(changes: DataFrame, timing: Timing | None = None, lateness="0 seconds"):
    """Notifications of a stream of changes ``(receiver, group_key, ts, up, down)``."""
    rows = changes.withWatermark("ts", lateness).select(
        *GROUP, "ts", F.unix_micros("ts").alias("at_us"), "up", "down"
    )
    notes = rows.groupBy(*GROUP).transformWithStateInPandas(
        NotifyProcessor(timing or Timing()), NOTES, "Append", "eventTime"
    )
    return notes.select(*GROUP, F.timestamp_millis("sent_ms").alias("sent_at"), "reason", "firing")
