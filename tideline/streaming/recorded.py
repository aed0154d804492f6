"""Streaming recording rule: windowed increase summed by labels.

A series keeps one state per closed slice of a window, whatever the number of steps in it.  Slices
are cut into blocks of one window's length: when a block is full, its states are replaced by states
that run from a slice to the end of the block, and the new block has one state that runs from its
beginning.  A window is the merge of one of each, so a step costs the same however long the window is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.model import label_key, label_map, micros

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = "n long, fx long, fv double, lx long, lv double, lost double"
RESULT = f"series_id string, window_at timestamp, t long, {WINDOW}"


class Growth(NamedTuple):
    """Samples in time order: their number, the first, the last, and what resets took away."""

    n: int
    fx: int
    fv: float
    lx: int
    lv: float
    lost: float

    @classmethod
    def of(cls, points: list[tuple[int, float]]) -> Growth:
        fallen = sum((a for (_, a), (_, b) in zip(points, points[1:], strict=False) if b < a), 0.0)
        return cls(len(points), *points[0], *points[-1], fallen)


def merged(a: Growth | None, b: Growth | None) -> Growth | None:
    """An earlier and a later state as one."""
    if a is None or b is None:
        return b if a is None else a
    return Growth(a.n + b.n, a.fx, a.fv, b.lx, b.lv, a.lost + b.lost + (a.lv if b.fv < a.lv else 0.0))


class Slices:
    """Rows of a map state by slice, read at most once and written when all ticks are done."""

    def __init__(self, state, none: bool, at_once: bool):
        self.state, self.rows, self.stored, self.changed = state, {}, set(), set()
        self.whole = none
        if at_once:
            self._read_all()

    def _read_all(self) -> None:
        if not self.whole:
            read = {k[0]: tuple(row) for k, row in self.state.iterator()}
            self.stored |= read.keys()
            self.rows, self.whole = read | self.rows, True

    def get(self, k: int) -> tuple | None:
        if k not in self.rows and not self.whole:
            held = self.state.containsKey((k,))
            self.rows[k] = tuple(self.state.getValue((k,))) if held else None
            if held:
                self.stored.add(k)
        return self.rows.get(k)

    def put(self, k: int, row: tuple | None) -> None:
        """A row of a new slice, or instead of one that was read."""
        self.rows[k] = row
        self.changed.add(k)

    def present(self) -> list[tuple[int, tuple]]:
        """All rows, the latest slice first."""
        self._read_all()
        return sorted(((k, row) for k, row in self.rows.items() if row is not None), reverse=True)

    def write(self) -> None:
        for k in self.changed:
            if self.rows[k] is not None:
                self.state.updateValue((k,), self.rows[k])
            elif k in self.stored:
                self.state.removeKey((k,))


class WindowProcessor(StatefulProcessor):
    """States of the closed windows of one series, ``length`` slices of ``width`` microseconds each.

    Slice ``k`` ends at ``k * width`` and holds that instant; windows also hold the one on their left
    edge.  State: samples of open slices; a row per closed slice that a coming window can touch,
    with its own sample on the edge and the next slice in its block; the last tick, the running
    state of the present block, the slice at which the tail begins, and the number of rows.
    """

    def __init__(self, width: int, length: int):
        self.width, self.length = width, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "x long, value double")
        self.slices = handle.getMapState("slices", "k long", f"{WINDOW}, edged boolean, edge double, after long")
        self.run = handle.getValueState("run", f"tick long, tail long, rows long, {WINDOW}")

    def _end(self, x: int) -> int:
        return -(-x // self.width)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            points = list(zip(frame["x"].tolist(), frame["value"].tolist(), strict=True))
            self.waiting.appendList(points)
            first = min([x for x, _ in points] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(self._end(first) * self.width // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs() * 1000 // self.width
        tick, tail, rows, head = None, -1, 0, None
        if self.run.exists():
            tick, tail, rows, *state = self.run.get()
            head = Growth(*state) if state[0] else None
        if tick is not None and tick >= final:
            return
        due: dict[int, list] = {}
        open_ = []
        for x, value in self.waiting.get():
            if self._end(x) <= final:
                due.setdefault(self._end(x), []).append((x, value))
            else:
                open_.append((x, value))
        starts, found = sorted(due), []
        slices = Slices(self.slices, none=not rows, at_once=tick is not None and final - tick > 4)
        tick = starts[0] - 1 if tick is None and starts else tick
        while tick is not None and tick < final:
            if not rows and head is None:  # nothing in reach: go on where samples are
                starts = [k for k in starts if k > tick]
                if not starts:
                    break
                tick = starts[0] - 1
            tick += 1
            if (tick - 1) % self.length == 0:
                tail, head = self._close_block(slices, tick), None
            if tick in due:
                points = sorted(due[tick])
                own = Growth.of(points)
                edged = points[-1][0] == tick * self.width
                slices.put(tick, (*own, edged, points[-1][1] if edged else 0.0, -1))
                head, rows = merged(head, own), rows + 1
            gone = tick - self.length
            while tail != -1 and tail <= gone:
                tail = slices.get(tail)[8]
            window = merged(Growth(*slices.get(tail)[:6]) if tail != -1 else None, head)
            if rows and slices.get(gone) is not None:
                *_, edged, edge, _ = slices.get(gone)
                if edged:
                    at = gone * self.width
                    window = merged(Growth(1, at, edge, at, edge, 0.0), window)
                slices.put(gone, None)
                rows -= 1
            if window is not None and window.n > 1:
                found.append((*key, tick * self.width, *window))
            if not rows:
                head = None
        slices.write()
        if len(open_) + len(due):
            if open_:
                self.waiting.put(open_)
            else:
                self.waiting.clear()
        if rows:
            self.run.update((tick, tail, rows, *(head or Growth(0, 0, 0.0, 0, 0.0, 0.0))))
            self.handle.registerTimer((final + 1) * self.width // 1000)
        else:
            self.run.clear()
            if open_:
                self.handle.registerTimer(self._end(min(open_)[0]) * self.width // 1000)
        if found:
            out = pd.DataFrame(found, columns=["series_id", "t", "n", "fx", "fv", "lx", "lv", "lost"])
            # event-time windows are half open on the right
            yield out.assign(window_at=pd.to_datetime(out["t"] - 1, unit="us"))[
                ["series_id", "window_at", "t", "n", "fx", "fv", "lx", "lv", "lost"]
            ]

    def _close_block(self, slices: Slices, tick: int) -> int:
        """Turn the states of the block before ``tick`` into states to its end; the first slice of them."""
        so_far, after = None, -1
        for k, row in slices.present():
            if k > tick - 1 - self.length:
                so_far = merged(Growth(*row[:6]), so_far)
                slices.put(k, (*so_far, *row[6:8], after))
                after = k
        return after

    def close(self) -> None:
        pass


def stream_recorded(
    samples: DataFrame, d, step, by: list[str], lateness: str = "0 seconds", mode="extrapolated"
) -> DataFrame:
    """``sum by(labels) (increase(samples[d]))`` at every step, as ``(labels…, ts, value)``.

    A step is emitted when the watermark (``lateness`` behind the newest sample) passes
    its end; ``d`` must be a multiple of ``step``.  Needs the RocksDB state store.
    """
    width, size = micros(step), micros(d)
    if size % width:
        raise ValueError("the window must be a multiple of the step")
    # Event-time windows are half open on the right; one microsecond less closes them there.
    if width % 1000:
        raise ValueError("the step must be whole milliseconds")
    rows = samples.withWatermark("ts", lateness).select("series_id", "ts", F.unix_micros("ts").alias("x"), "value")
    found = rows.groupBy("series_id").transformWithStateInPandas(
        WindowProcessor(width, size // width), RESULT, "Append", "eventTime", eventTimeColumnName="window_at"
    )
    parts = found.selectExpr(
        "series_id",
        "window_at",
        "lv - fv + lost AS grown",
        "fv AS first",
        "(lx - fx) / 1e6D AS covered",
        "(lx - fx) / 1e6D / (n - 1) AS gap",
        f"(fx - (t - {size})) / 1e6D AS to_start",
        "(t - lx) / 1e6D AS to_end",
    )
    near = "CASE WHEN {0} >= gap * 1.1D THEN gap / 2 ELSE {0} END"
    start, end = near.format("to_start"), near.format("to_end")
    capped = f"CASE WHEN grown > 0 AND first >= 0 THEN least({start}, covered * (first / grown)) ELSE {start} END"
    value = "grown" if mode == "raw" else f"grown * ((covered + {capped} + {end}) / covered)"
    labels = F.from_json("series_id", "map<string,string>")
    named = parts.select(
        "window_at",
        *[F.coalesce(labels[name], F.lit("")).alias(name) for name in by],
        F.expr(value).alias("value"),
    )
    summed = named.groupBy(F.window("window_at", f"{width} microseconds").alias("w"), *by).agg(
        F.sum("value").alias("value")
    )
    return summed.select(*by, F.col("w.end").alias("ts"), "value")


def recorded_samples(recorded: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Rule results as samples of a new series."""
    labels = label_map({x: F.col(x) for x in by})
    return recorded.select(
        F.lit(name).alias("metric"),
        labels.alias("labels"),
        label_key(labels).alias("series_id"),
        "ts",
        "value",
    )
