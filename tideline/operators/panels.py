"""Frames that panels draw: distributions, reducers, tables, gap fill and comparisons."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.templates import render_text
from tideline.model import COLUMNS, LABELS, Grid, label
from tideline.operators.vector import neg


def distribution(
    df: DataFrame,
    low: float,
    high: float,
    value: str,
    by: str = "site",
    bins: int = 50,
    mask=None,
) -> DataFrame:
    """PDF and CDF per group over log-spaced bins between ``low`` and ``high``.

    Values outside are counted in the outermost bins; every group has all bins.
    """
    if mask is not None:
        df = df.filter(mask)
    step = (math.log(high) - math.log(low)) / bins
    clamped = F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))
    bin_no = F.least(
        F.floor((F.ln(clamped) - F.lit(math.log(low))) / F.lit(step)), F.lit(bins - 1)
    )
    rows = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull())
    counts = rows.groupBy(by, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    dense = counts.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("filled"),
        F.sum("n").alias("total"),
    )
    cells = dense.select(
        by, "filled", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    count = F.coalesce(F.col("filled")[F.col("bin").cast("bigint")], F.lit(0))
    running = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select(
        F.exp(F.lit(math.log(low)) + (F.col("bin") + 1) * F.lit(step)).alias("xright"),
        "bin",
        by,
        (count / F.col("total")).alias(f"{by}_pdf"),
        (F.sum(count).over(running) / F.col("total")).alias(f"{by}_cdf"),
    )


def median_map(df: DataFrame, value: str, by: list[str], more_than: int) -> DataFrame:
    """Approximate median per location with more than ``more_than`` rows."""
    out = df.groupBy(*by).agg(
        F.percentile_approx(value, 0.5, 10_000).alias("value"),
        F.count(F.lit(1)).alias("value_tests"),
    )
    located = out.filter((F.col("value_tests") > more_than) & F.col("value").isNotNull())
    for column in by:
        located = located.filter(F.col(column).isNotNull())
    return located


def point_frame(v: DataFrame, name: str, places: DataFrame, key: str) -> DataFrame:
    """Gauge values placed by a label, joined to a table of locations."""
    points = v.select("ts", label(name).alias(key), "value")
    return points.join(places, key)


def reduce_series(v: DataFrame, how: str) -> DataFrame:
    """One row per series over the panel range: last, mean, max, min, sum."""
    present = v.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    value = {
        "last": F.max_by("value", "ts"),
        "mean": F.avg("value"),
        "max": F.max("value"),
        "min": F.min("value"),
        "sum": F.sum("value"),
    }[how]
    return present.groupBy("metric", "series_id").agg(value.alias("value"))


def instant_table(v: DataFrame, labels: list[str]) -> DataFrame:
    """Samples with labels as columns."""
    return v.select("ts", *[label(x).alias(x) for x in labels], "value")


def current_table(v: DataFrame) -> DataFrame:
    return reduce_series(v, "last")


def organize(df: DataFrame, drop: list[str] = (), rename: dict[str, str] | None = None):
    out = df.drop(*drop)
    for old, new in (rename or {}).items():
        out = out.withColumnRenamed(old, new)
    return out


def hide_all(v: DataFrame, what: str) -> DataFrame:
    """Without the series whose samples are all zero (or all null)."""
    interesting = F.col("value").isNotNull() & ~F.isnan("value")
    if what == "zero":
        interesting = interesting & (F.col("value") != 0)
    shown = v.filter(interesting).select("metric", "series_id").distinct()
    named = v.withColumn("_m", F.coalesce("metric", F.lit("")))
    keys = shown.select(F.coalesce("metric", F.lit("")).alias("_m"), "series_id").distinct()
    return named.join(keys, ["_m", "series_id"], "left_semi").select(*COLUMNS)


def null_as_zero(v: DataFrame, grid: Grid) -> DataFrame:
    """Every series at every instant, zero where it has no sample.

    Only samples are shuffled and sorted; the instants between two of a series are made where the samples
    lie, and labels are read once per sample.
    """
    # Dealt by series first, so that samples of one instant and the order within a series need no other shuffle.
    dealt = v.select("metric", "series_id", "ts", "value").repartition("series_id")
    best = dealt.groupBy("metric", "series_id", "ts").agg(F.max("value").alias("value"))
    by_series = "OVER (PARTITION BY metric, series_id ORDER BY ts)"
    us, step = f"(unix_micros(ts) - {grid.start})", f"{grid.step}L"
    upto = f"(({us} - pmod({us}, {step})) div {step})"  # last instant that is not after a sample
    before = f"({upto} - CASE WHEN pmod({us}, {step}) = 0 THEN 1L ELSE 0L END)"
    placed = best.selectExpr(
        "metric",
        "series_id",
        "ts",
        "coalesce(value, 0D) AS value",
        f"greatest(coalesce({upto}, -1L) + 1, 0L) AS after",
        f"least(coalesce({before}, -1L), {grid.last}L) AS until",
    ).selectExpr(
        "metric",
        f"from_json(series_id, '{LABELS}') AS labels",
        "series_id",
        "ts",
        "value",
        "after",
        "until",
        f"lead(until, 1, {grid.last}L) {by_series} AS next",
        f"row_number() {by_series} = 1 AS is_first",
    )
    # the sample itself, the instants after it, and for the first sample those before it
    parts = (
        "explode(array(named_struct('own', true, 'low', 0L, 'high', 0L),"
        " named_struct('own', false, 'low', after, 'high', next),"
        " named_struct('own', false, 'low', 0L, 'high', CASE WHEN is_first THEN until ELSE -1L END))) AS p"
    )
    spans = placed.selectExpr("metric", "labels", "series_id", "ts", "value", parts).filter("p.low <= p.high")
    cells = spans.selectExpr(
        "metric", "labels", "series_id", "ts", "value", "p.own AS own", "explode(sequence(p.low, p.high)) AS j"
    )
    return cells.selectExpr(
        "metric",
        "labels",
        "series_id",
        f"CASE WHEN own THEN ts ELSE timestamp_micros({grid.start} + j * {grid.step}) END AS ts",
        "CASE WHEN own THEN value ELSE 0D END AS value",
    )


def series_total(v: DataFrame, by: list[str]) -> DataFrame:
    return v.groupBy(*[label(x).alias(x) for x in by]).agg(F.sum("value").alias("value"))


def legend(v: DataFrame, template: str) -> DataFrame:
    """Series name from ``{{label}}`` references."""

    return v.withColumn("legend", render_text(template))


def compare_offsets(fn: Callable[[int], DataFrame], offsets: dict[str, int]) -> DataFrame:
    """The same query now and some time earlier, tagged by period."""
    out = None
    for name, shift in offsets.items():
        part = fn(shift).select(*COLUMNS).withColumn("period", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def mirror(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Traffic frame with the received side drawn downwards."""
    up = sent.select(*COLUMNS).withColumn("direction", F.lit("out"))
    down = neg(received).select(*COLUMNS).withColumn("direction", F.lit("in"))
    return up.unionByName(down)


def series_arrays(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Per group the x and y arrays in x order.  Groups hold one row per bin."""
    points = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    grouped = df.groupBy(by).agg(points.alias("p"))
    return grouped.select(by, F.col("p.x").alias("x"), F.col("p.y").alias("y")).orderBy(by)
