"""Aggregation across series at each evaluation instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.floats import NAN
from tideline.model import COLUMNS, Grid, label, label_key, label_map
from tideline.operators.matching import binop, v_and, v_or_all, v_unless
from tideline.operators.quantile import exact_quantile
from tideline.operators.relabel import label_set
from tideline.operators.select import Matcher, eq, select
from tideline.operators.vector import arith, compare, scalar, with_scalar


def _value(how: str) -> Column:
    if how == "count":
        return F.count(F.lit(1)).cast("double")
    if how == "max":  # Spark orders NaN last; only an all-NaN group has maximum NaN
        return F.coalesce(F.max(F.when(~F.isnan("value"), F.col("value"))), F.lit(NAN))
    return {"sum": F.sum, "avg": F.avg, "min": F.min}[how]("value")


def agg(v: DataFrame, how: str, by: list[str] | None = None, q: float | None = None) -> DataFrame:
    """``how by (labels)``: sum, count, avg, min, max or quantile.  Empty in, empty out."""
    by = by or []
    names = [f"_by{i}" for i in range(len(by))]
    keys = ["ts", *names]
    projected = v.select("ts", *[label(x).alias(n) for x, n in zip(by, names)], "value")
    if how == "quantile":
        out = exact_quantile(projected, keys, "value", q)
    else:
        out = projected.groupBy(*keys).agg(_value(how).alias("value"))
    labels = label_map({x: F.col(n) for x, n in zip(by, names)})
    return out.select(
        F.lit(None).cast("string").alias("metric"),
        labels.alias("labels"),
        label_key(labels).alias("series_id"),
        "ts",
        "value",
    )


def merged(v: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The series of a group added up at every instant of a sample, before any window is formed.

    A sum over windows adds up in any order, so ``agg(over_time(v, "sum", ...), "sum", by)`` has equal rows
    on ``merged(v, by)``, where a window is formed once per group and not once per series.  Samples of one
    instant become one, as windows expect of a series.
    """
    return agg(v, "sum", by)


def topk(v: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` largest samples per instant, ties broken by series; labels stay."""
    value = F.when(~F.isnan("value"), F.col("value"))
    order = Window.partitionBy("ts", *[label(x) for x in by or []]).orderBy(
        value.desc_nulls_last(), "series_id", "metric"
    )
    return v.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select(*COLUMNS)


def ratio(v: DataFrame, part: Matcher, by: list[str] | None = None) -> DataFrame:
    """Share of the samples that match; without any match there is no row."""
    matching = agg(v.filter(part.condition()), "sum", by)
    return binop("/", matching, agg(v, "sum", by))


def bucket_share(v: DataFrame, le: str, grid: Grid, top: str = "+Inf") -> DataFrame:
    """Fraction of observations under a bound of a cumulative histogram."""
    under = agg(select(v, None, eq("le", le)), "sum")
    total = scalar(agg(select(v, None, eq("le", top)), "sum"), grid.instants(v.sparkSession))
    return with_scalar(under, "/", total)


def availability(signals: list[DataFrame], members: DataFrame, excused: DataFrame, by: list[str]):
    """Healthy members (worst of several 0/1 signals) over members that are not excused.

    ``by`` holds the grouping labels; the last one names the member.
    """
    worst = agg(v_or_all(*signals), "min", by)
    return binop("/", agg(worst, "sum"), agg(v_unless(members, excused, on=by[-1:]), "count"))


def seasonal_low(v: DataFrame, earlier: dict[str, DataFrame], by: list[str], fraction: float):
    """Samples below a fraction of the median of the same series at earlier times.

    ``earlier`` names the shifted vectors; a ``delay`` label keeps them apart.
    """
    parts = [label_set(shifted, "delay", name) for name, shifted in earlier.items()]
    base = agg(v_or_all(*parts), "quantile", by, q=0.5)
    return binop("<", v, arith(base, "*", fraction))


def stopped_since(recent: DataFrame, earlier: DataFrame) -> DataFrame:
    """Groups that grew before and do not grow now."""
    return v_and(compare(recent, "==", 0), compare(earlier, ">", 0))
