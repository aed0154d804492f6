"""Exact quantiles of sliding windows that are long, or hold few samples each.

Repeating each sample for every evaluation whose window holds it costs ``d / step`` rows a sample.
In long windows a sample only changes two counts, where it enters the windows and where it leaves them:

* values of a series are cut into a few ranges, at quantiles of a mergeable sketch; a cut is a
  range of its own, so a value that fills much of a window needs no further look;
* running sums of the changes give the counts of all ranges between two changes, hence the range
  that holds the wanted rank, and the rank inside it;
* only where that range holds several values are its samples read again, those of the range alone.

Windows of few samples (``gathered_quantile``) need no counts: the samples of a series in a stretch of
several windows are shuffled once, unrepeated, and each window is sorted in memory.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.floats import INF
from tideline.operators.slices import SERIES
from tideline.shared import expanded, stored

#: Cuts between ranges, and the accuracy of the sketch they come from.
CUTS, ACCURACY = 15, 1000
RANGES = 2 * CUTS + 1
#: Windows in a stretch whose samples are gathered.
WINDOWS = 4


def sliding_quantile(near: DataFrame, q: float, length: int, last: int) -> DataFrame:
    """``(metric, series_id, j, value)`` for every evaluation whose window has a sample.

    ``near`` holds ``value`` and the first and last evaluation (``first``, ``final``) of each
    sample; a window is ``length`` evaluations long and the last evaluation is ``last``.  NaN is
    above all other values.  Time is cut into stretches of ``length`` evaluations, which spreads a
    busy series, as a sample meets two stretches at most.
    """
    rows = near.filter("value IS NOT NULL").select(*SERIES, "value", "first", "final")
    if q < 0 or q > 1 or math.isnan(q):
        held = _stretched(rows.select(*SERIES, F.lit(0).alias("range"), "value", "first", "final"), length)
        edge = F.lit(q if math.isnan(q) else math.copysign(INF, q))
        return _unfolded(_changes(held).filter(f"n{RANGES - 1} > 0")).select(*SERIES, "j", edge.alias("value"))

    ranged = stored(_ranged(rows), "ranged")
    counts = _changes(_stretched(ranged, length))
    total = F.col(f"n{RANGES - 1}")
    rank = F.lit(q) * (total - 1)
    placed = counts.filter(total > 0).select(
        *SERIES,
        "stretch",
        "at",
        "until",
        (rank - F.floor(rank)).alias("weight"),
        F.explode(
            F.array(_place(F.floor(rank), "low"), F.when(F.floor(rank) != F.ceil(rank), _place(F.ceil(rank), "high")))
        ).alias("p"),
    )
    placed = placed.filter("p IS NOT NULL").select(*SERIES, "stretch", "at", "until", "weight", "p.*")
    return _interpolated(placed, _stretched(ranged, length))


def gathered_quantile(near: DataFrame, q: float, length: int) -> DataFrame:
    """The same for ``q`` from 0 to 1, where the samples of ``WINDOWS + 1`` windows of a series fit in memory.

    Time is cut into stretches of ``WINDOWS`` windows, so most samples are in one.  The number of tasks is
    explicit: merging partitions by their size before windows are formed makes them too large after it.
    """
    span = WINDOWS * length
    parts = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = near.filter("value IS NOT NULL").selectExpr(
        *SERIES, "value", "first", "final", f"explode(sequence(first div {span}, final div {span})) AS stretch"
    )
    together = rows.repartition(parts, "series_id", "stretch").groupBy(*SERIES, "stretch")
    held = together.agg(F.expr("collect_list(struct(first, final, value)) AS held"))
    ticks = (
        f"sequence(greatest(array_min(held.first), stretch * {span}),"
        f" least(array_max(held.final), (stretch + 1) * {span} - 1))"
    )
    inside = "sort_array(transform(filter(held, h -> h.first <= j AND h.final >= j), h -> h.value))"
    each = held.selectExpr(*SERIES, f"inline(transform({ticks}, j -> struct(j, {inside} AS values)))")
    rank = F.lit(q) * (F.size("values") - 1)
    weight = rank - F.floor(rank)
    low, high = [F.element_at("values", (place(rank) + 1).cast("int")) for place in (F.floor, F.ceil)]
    value = F.when(weight == 0, low).otherwise(low * (1 - weight) + high * weight)
    return each.filter("size(values) > 0").select(*SERIES, "j", value.alias("value"))


def _same(left: str, right: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in SERIES])


def _ranged(rows: DataFrame) -> DataFrame:
    """Rows with the number ``range`` of their value's range: odd for a cut, even between cuts."""
    shares = F.array(*[F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)])
    plain = F.when(~F.isnan("value"), F.col("value"))
    cuts = rows.groupBy(*SERIES).agg(F.array_distinct(F.percentile_approx(plain, shares, ACCURACY)).alias("cuts"))
    joined = rows.alias("s").join(cuts.alias("c"), _same("s", "c"))
    known = F.coalesce("c.cuts", F.array().cast("array<double>"))
    below = F.size(F.filter(known, lambda x: x < F.col("s.value")))
    on = F.array_contains(known, F.col("s.value")).cast("int")
    return joined.select(*[f"s.{k}" for k in SERIES], (2 * below + on).alias("range"), "s.value", "s.first", "s.final")


def _stretched(rows: DataFrame, length: int) -> DataFrame:
    """Rows repeated for the stretches they meet, cut to them."""
    first, final = f"first div {length}", f"final div {length}"
    each = rows.selectExpr("*", f"explode(sequence({first}, {final})) AS stretch")
    return each.selectExpr(
        *SERIES, "range", "value", "stretch",
        f"greatest(first, stretch * {length}) AS first", f"least(final, (stretch + 1) * {length} - 1) AS final",
    )


def _changes(held: DataFrame) -> DataFrame:
    """Counts ``n0 …`` of values up to each range, between two changes ``at`` and ``until``, per series and stretch."""
    columns = held.filter("first <= final").selectExpr(
        *SERIES, "stretch", "range", "explode(array(named_struct('at', first, 'd', 1L), named_struct('at', final + 1, 'd', -1L))) AS e"
    )
    by_range = [f"sum(CASE WHEN range <= {i} THEN e.d ELSE 0L END) AS d{i}" for i in range(RANGES)]
    changes = columns.groupBy(*SERIES, "stretch", F.col("e.at").alias("at")).agg(*map(F.expr, by_range))
    order = "OVER (PARTITION BY metric, series_id, stretch ORDER BY at)"
    upto = "OVER (PARTITION BY metric, series_id, stretch ORDER BY at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    running = [f"sum(d{i}) {upto} AS n{i}" for i in range(RANGES)]
    return changes.selectExpr(*SERIES, "stretch", "at", f"lead(at) {order} - 1 AS until", *running).filter("until IS NOT NULL")


def _place(rank: Column, side: str) -> Column:
    """Range of a rank and the rank inside it, counted from 0."""
    below = F.filter(F.array(*[F.col(f"n{i}") for i in range(RANGES)]), lambda n: n <= rank)
    inside = rank.cast("long") - F.coalesce(F.array_max(below), F.lit(0))
    return F.struct(F.lit(side).alias("side"), F.size(below).alias("range"), inside.alias("rank"))


def _interpolated(placed: DataFrame, held: DataFrame) -> DataFrame:
    """Read the wanted values and interpolate between the lower and the higher."""
    cut_value = held.filter("range % 2 = 1").groupBy(*SERIES, "range").agg(F.min("value").alias("value"))
    on_cut = placed.filter("range % 2 = 1").alias("p").join(
        expanded(cut_value).alias("c"), _same("p", "c") & (F.col("p.range") == F.col("c.range"))
    )
    keys = [*SERIES, "stretch", "at", "until", "weight", "side"]
    plain = on_cut.select(*[f"p.{k}" for k in keys], "c.value")

    between = placed.filter("range % 2 = 0").alias("p").join(
        expanded(held.filter("range % 2 = 0")).alias("h"),
        _same("p", "h")
        & (F.col("p.stretch") == F.col("h.stretch"))
        & (F.col("p.range") == F.col("h.range"))
        & (F.col("h.first") <= F.col("p.at"))
        & (F.col("h.final") >= F.col("p.at")),
    )
    sorted_values = F.array_sort(F.collect_list("h.value"))
    read = between.groupBy(*[F.col(f"p.{k}") for k in keys], F.col("p.rank")).agg(sorted_values.alias("values"))
    read = read.select(*keys, F.element_at("values", (F.col("rank") + 1).cast("int")).alias("value"))
    sides = plain.unionByName(read).groupBy(*SERIES, "stretch", "at", "until", "weight").agg(
        F.max(F.when(F.col("side") == "low", F.col("value"))).alias("low"),
        F.max(F.when(F.col("side") == "high", F.col("value"))).alias("high"),
    )
    value = F.when(F.col("weight") == 0, F.col("low")).otherwise(F.col("low") * (1 - F.col("weight")) + F.col("high") * F.col("weight"))
    return _unfolded(sides.withColumn("value", value)).select(*SERIES, "j", "value")


def _unfolded(rows: DataFrame) -> DataFrame:
    """One row per evaluation between two changes."""
    return rows.select("*", F.explode(F.sequence("at", "until")).alias("j"))
