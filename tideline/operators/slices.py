"""Sliding windows over sliced partial states.

Trailing windows of ``d`` evaluated every ``s`` start at multiples of ``s`` and end ``d`` later.
The time axis is cut at just these instants, so a step has two slices (one if ``s`` divides
``d``), whatever the divisors of the two are.
Samples are first folded to one mergeable state per (series, slice), which spreads a
busy series over its slices; only slice states, whose number per series is bounded by
the time axis, meet per series.  They are combined in one of two exact ways:

* a short window (``d / s`` up to ``SPREAD``) repeats each state for the evaluations it
  belongs to and aggregates, which costs nothing for evaluations without samples;
* a long window is the end of one block of slices and the beginning of the next, so it is
  merged from a state that runs backwards and one that runs forwards, at a constant cost per
  slice however long the window is.

Windows are closed on both ends, so a slice also keeps the sample that lies exactly on
its right edge, for the window that starts there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.model import DAY, LABELS, Grid, instant_literal

SERIES = ["metric", "series_id"]
ORDERED_SLICE = 3_600_000_000
DIRECT = 8
SPREAD = 64


@dataclass(frozen=True)
class Family:
    """Mergeable window state, as SQL expressions.

    ``build`` aggregates the samples ``(x, value)`` of a slice (with the in-slice
    predecessor ``prev_x``, ``prev_value`` when ``ordered``); ``edge`` is the state of the
    single sample ``(x, value)`` on the slice's right edge; ``merge`` combines an earlier
    state ``a`` with a later state ``b``, both non-null; ``gather`` aggregates states
    ``c`` of one window that starts at ``w0``, where an ordered state also has the last
    sample ``before_x``, ``before_value`` of the series' previous slice.  Aggregates are
    over plain columns, which keeps them in hash aggregation.  ``running`` is the state of all
    rows of a frame ``{w}`` that grows from one end of a block (``origin`` is the state there);
    ``earlier`` and ``later`` are the state and its neighbour in the frame, in order of time,
    null where there is no neighbour.
    """

    build: str
    edge: str
    merge: str
    running: str
    gather: str | None = None
    ordered: bool = False

    def joined(self, older: str, newer: str) -> str:
        merged = re.sub(r"\b(a|b)\.", lambda m: f"{older if m[1] == 'a' else newer}.", self.merge)
        merged = newer if merged == "b" else merged
        return f"CASE WHEN {older} IS NULL THEN {newer} WHEN {newer} IS NULL THEN {older} ELSE {merged} END"


def in_reach(v: DataFrame, grid: Grid, d: int, offset: int) -> DataFrame:
    """Samples that some window covers, with ``x`` = microseconds after the first window's start."""
    origin = grid.start - d - offset
    low, high = instant_literal(origin), instant_literal(grid.start + grid.last * grid.step - offset)
    near = v.filter(F.col("ts").between(low, high))
    near = near.selectExpr(*SERIES, *_day(near), "value", f"unix_micros(ts) - {origin} AS x")
    if d < grid.step:
        near = near.filter(f"pmod(x, {grid.step}) <= {d}")
    return near


def _day(v: DataFrame) -> list[str]:
    return ["day"] if "day" in v.columns else []


@dataclass(frozen=True)
class Cuts:
    """Slices of the time axis, by number.

    In each step, windows start at 0 and end at ``end``; the two stretches between are cut
    into ``head`` and ``tail`` equal parts (several only when order matters, so that no
    slice is longer than an hour).  Slice k covers ``(at(k - 1), at(k)]``.
    """

    step: int
    end: int
    head: int
    tail: int

    @classmethod
    def of(cls, grid: Grid, d: int, ordered: bool) -> Cuts:
        end = d % grid.step
        longest = ORDERED_SLICE if ordered else grid.step
        return cls(grid.step, end, -(-end // longest), -(-(grid.step - end) // longest))

    @property
    def stride(self) -> int:
        """Slices from one evaluation to the next."""
        return self.head + self.tail

    def length(self, d: int) -> int:
        """Slices of a window."""
        return d // self.step * self.stride + self.head

    def number(self, x: str = "x") -> str:
        """SQL of the slice that holds instant ``x``."""
        p, rest = f"pmod({x}, {self.step})", self.step - self.end
        tail = f"{self.head} + (({p} - {self.end}) * {self.tail} + {rest - 1}) div {rest}"
        part = f"WHEN {p} <= {self.end} THEN ({p} * {self.head} + {self.end - 1}) div {self.end} " if self.end else ""
        return f"{x} div {self.step} * {self.stride} + CASE WHEN {p} = 0 THEN 0L {part}ELSE {tail} END"

    def at(self, k: str = "k") -> str:
        """SQL of the right end of slice ``k``."""
        r = f"pmod({k}, {self.stride})"
        tail = f"{self.end} + ({r} - {self.head}) * {self.step - self.end} div {self.tail}"
        part = f"CASE WHEN {r} <= {self.head} THEN {r} * {self.end} div {self.head} ELSE {tail} END" if self.head else tail
        return f"({k} div {self.stride} * {self.step} + {part})"


def windows(v: DataFrame, d: int, grid: Grid, family: Family, offset: int = 0) -> DataFrame:
    """``(metric, series_id, ts, state)`` for every evaluation whose window has a sample."""
    cuts = Cuts.of(grid, d, family.ordered)
    length, stride = cuts.length(d), cuts.stride
    near = in_reach(v, grid, d, offset)
    # Where days end at cuts, slices lie within days, and samples stored by day are folded in place.
    whole_days = DAY % grid.step == 0 and (grid.start - d - offset) % grid.step == 0
    day = _day(near) if whole_days else []

    if not day and not family.ordered and family.gather and d <= DIRECT * grid.step:
        return _direct(near, family, d, grid)

    cut = near.selectExpr(*SERIES, *day, "x", "value", f"{cuts.number()} AS k")
    if family.ordered:
        within = f"OVER (PARTITION BY {', '.join([*SERIES, *day, 'k'])} ORDER BY x, value)"
        cut = cut.selectExpr("*", f"lag(x) {within} AS prev_x", f"lag(value) {within} AS prev_value")
    partial = cut.groupBy(*SERIES, *day, "k").agg(
        F.expr(f"{family.build} AS state"),
        F.expr(f"max(CASE WHEN x = {cuts.at()} THEN value END) AS edge"),
    )
    edge = family.edge.replace("{x}", cuts.at()).replace("{y}", "edge")
    partial = partial.selectExpr(
        *SERIES, "k", "state", f"CASE WHEN edge IS NOT NULL THEN {edge} END AS edge"
    )
    if family.gather and d <= SPREAD * grid.step:
        return _spread(partial, family, length, stride, grid)
    return _blocks(partial, family, length, stride, grid)


def _direct(near: DataFrame, family: Family, d: int, grid: Grid) -> DataFrame:
    """Repeat each sample for the evaluations ``j`` whose window holds it."""
    # window j covers x in [j*step, j*step + d]
    first = f"CASE WHEN x <= {d} THEN 0L ELSE (x - {d} + {grid.step - 1}) div {grid.step} END"
    final = f"least({grid.last}L, x div {grid.step})"
    each = near.selectExpr(*SERIES, "x", "value", f"explode(sequence({first}, {final})) AS j")
    found = each.groupBy(*SERIES, "j").agg(F.expr(f"{family.build} AS state"))
    return found.selectExpr(
        *SERIES, f"timestamp_micros({grid.start} + j * {grid.step}) AS ts", "state"
    )


def _spread(partial, family, length, stride, grid) -> DataFrame:
    """Repeat each slice state for the evaluations ``j`` whose window holds it."""
    # All evaluations of a series meet in one place, so repeated states are not shuffled.
    # The count is explicit: merging partitions by their size before the repeat makes them
    # too large after it.
    parts = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states, before = partial.repartition(parts, "series_id"), []
    if family.ordered:
        by_series = "OVER (PARTITION BY metric, series_id ORDER BY k)"
        before = ["before_x", "before_value"]
        states = states.selectExpr(
            "*",
            f"lag(state.last.x) {by_series} AS before_x",
            f"lag(state.last.value) {by_series} AS before_value",
        )
    # window j covers slices (j*stride, j*stride + length] and the edge of slice j*stride
    first = f"greatest(0L, CAST(ceil((k - {length}) / {stride}) AS bigint))"
    final = f"least({grid.last}L, k div {stride})"
    states = states.filter(f"{first} <= {final}")
    each = states.selectExpr(
        *SERIES, "k", "state", "edge", *before, f"explode(sequence({first}, {final})) AS j"
    )
    each = each.selectExpr(
        *SERIES,
        "j",
        f"j * {grid.step} AS w0",
        *before,
        f"CASE WHEN k = j * {stride} THEN edge ELSE state END AS c",
    )
    found = each.filter("c IS NOT NULL").groupBy(*SERIES, "j").agg(
        F.expr(f"{family.gather} AS state")
    )
    return found.selectExpr(
        *SERIES, f"timestamp_micros({grid.start} + j * {grid.step}) AS ts", "state"
    )


def _blocks(partial, family, length, stride, grid) -> DataFrame:
    """Merge each window from two running states.

    The time axis is cut into blocks of one window's length.  A window is the end of one block
    and the beginning of the next, so its state is the merge of a state that runs backwards
    through the first and one that runs forwards through the second: two running states per
    slice and one merge per change of a window, whatever the length.  Slices without samples
    have no rows, and evaluations whose windows hold the same slices share one state.  Rows are
    keyed by series and block, so a busy series is spread over its blocks.
    """
    states = partial.selectExpr("*", f"(k + {length - 1}) div {length} - 1 AS block")
    inside = states.filter("k > 0")
    # Window j holds the slices (j*stride, j*stride + length]; it belongs to the block of its first.
    tail = _running(inside, family, forward=False).selectExpr(
        *SERIES, "block", "state", f"coalesce(beyond, block * {length}) AS low", "k - 1 AS high", "1 AS part"
    )
    head = _running(inside, family, forward=True).selectExpr(
        *SERIES,
        "block - 1 AS block",
        "state",
        f"k - {length} AS low",
        f"coalesce(beyond, (block + 1) * {length}) - 1 - {length} AS high",
        "2 AS part",
    )
    on_edge = states.filter(f"edge IS NOT NULL AND k % {stride} = 0").selectExpr(
        *SERIES, f"k div {length} AS block", "edge AS state", "k AS low", "k AS high", "0 AS part"
    )
    held = tail.unionByName(head).unionByName(on_edge).selectExpr(
        *SERIES,
        "block",
        "part",
        f"greatest(low + {stride - 1}, 0L) div {stride} AS first",
        f"CASE WHEN high < 0 THEN -1L ELSE least(high div {stride}, {grid.last}L) END AS final",
        "state",
    )
    # A state is held from its first evaluation to its last; each end is a place where windows change.
    ends = "explode(array(named_struct('at', first, 'on', true), named_struct('at', final + 1, 'on', false))) AS e"
    ends = held.filter("first <= final").selectExpr(*SERIES, "block", "part", "final", "state", ends)
    by_block = "OVER (PARTITION BY metric, series_id, block ORDER BY at)"
    parts = [
        f"last(CASE WHEN on AND part = {n} THEN named_struct('final', final, 'state', state) END, true) {by_block} AS p{n}"
        for n in range(3)
    ]
    changes = ends.selectExpr(*SERIES, "block", "part", "final", "state", "e.at", "e.on")
    changes = changes.selectExpr(*SERIES, "at", f"lead(at) {by_block} - 1 AS until", *parts).filter("until >= at")
    valid = [f"CASE WHEN p{n}.final >= at THEN p{n}.state END AS s{n}" for n in range(3)]
    found = changes.selectExpr(*SERIES, "at", "until", *valid)
    found = found.selectExpr(*SERIES, "at", "until", "s2", _settled(family.joined("s0", "s1"), "s01"))
    found = found.selectExpr(*SERIES, "at", "until", _settled(family.joined("s01", "s2"), "state"))
    each = found.filter("state IS NOT NULL").selectExpr(*SERIES, "state", "explode(sequence(at, until)) AS j")
    return each.selectExpr(*SERIES, f"timestamp_micros({grid.start} + j * {grid.step}) AS ts", "state")


def _running(states: DataFrame, family: Family, forward: bool) -> DataFrame:
    """State of each block from its beginning to a slice (or, backwards, from its end), and the
    neighbouring slice ``beyond`` that the state does not cover."""
    order = f"PARTITION BY metric, series_id, block ORDER BY k {'ASC' if forward else 'DESC'}"
    earlier, later = ("near", "CASE WHEN near IS NOT NULL THEN state END")[:: 1 if forward else -1]
    near = states.selectExpr(
        *SERIES,
        "block",
        "k",
        "state",
        f"lag(state) OVER ({order}) AS near",
        f"first(state) OVER ({order}) AS origin",
        f"lead(k) OVER ({order}) AS beyond",
    )
    near = near.selectExpr(*SERIES, "block", "k", "state", "origin", "beyond", f"{earlier} AS earlier", f"{later} AS later")
    so_far = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return near.selectExpr(*SERIES, "block", "k", "beyond", f"{family.running.format(w=so_far)} AS state")


def _settled(value: str, name: str) -> str:
    """Set a column behind a generator.

    Catalyst would inline a merged state into each of its uses, and merges of merges
    then grow past the limits of generated code.
    """
    return f"explode(array({value})) AS {name}"


def as_vector(df: DataFrame, value: str, keep_name: bool = False) -> DataFrame:
    return df.selectExpr(
        "metric" if keep_name else "CAST(NULL AS string) AS metric",
        f"from_json(series_id, '{LABELS}') AS labels",
        "series_id",
        "ts",
        f"CAST({value} AS double) AS value",
    )
