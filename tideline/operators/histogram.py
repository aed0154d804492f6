"""Quantiles and panel frames of cumulative bucket series (label ``le``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.floats import INF, NAN
from tideline.model import label, label_key, labels_of


def _bounds(v: DataFrame) -> DataFrame:
    rest = F.map_filter("labels", lambda k, _: k != "le")
    # A series without a number in ``le`` is no bucket; equal bounds written differently are one.
    # Dealing rows out by histogram first leaves the windows that follow nothing to shuffle.
    read = v.select(
        "ts", label_key(rest).alias("gid"), label("le").try_cast("double").alias("le"), "value"
    ).filter(F.col("le").isNotNull() & ~F.isnan("le"))
    return read.repartition("ts", "gid").groupBy("ts", "gid", "le").agg(F.sum("value").alias("value"))


def histogram_quantile(v: DataFrame, q: float) -> DataFrame:
    """``histogram_quantile(q, v)`` with linear interpolation inside the bucket."""
    by_le = Window.partitionBy("ts", "gid").orderBy("le")
    so_far = by_le.rowsBetween(Window.unboundedPreceding, 0)
    whole = by_le.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Counts may dip when buckets are collected at different moments.
    cum = _bounds(v).withColumn("cum", F.max("value").over(so_far))
    steps = cum.select(
        "ts",
        "gid",
        "le",
        "cum",
        F.lag("le").over(by_le).alias("prev_le"),
        F.lag("cum").over(by_le).alias("prev_cum"),
        F.last("cum").over(whole).alias("total"),
        F.last("le").over(whole).alias("top"),
        F.count("le").over(whole).alias("buckets"),
    )
    rank = F.lit(q) * F.col("total")
    hit = (F.col("cum") >= rank) & (F.col("prev_cum").isNull() | (F.col("prev_cum") < rank))
    if q < 0 or q > 1:  # no rank to look for: one row per histogram
        hit = F.col("prev_le").isNull()
    low = F.coalesce(F.col("prev_le"), F.lit(0.0))
    below = F.coalesce(F.col("prev_cum"), F.lit(0.0))
    width = F.col("cum") - below
    inside = low + (F.col("le") - low) * (
        (rank - below) / F.when(width == 0, F.lit(1.0)).otherwise(width)
    )
    value = (
        F.when((F.col("top") != INF) | (F.col("buckets") < 2) | (F.col("total") == 0), F.lit(NAN))
        .when(F.lit(q < 0), F.lit(-INF))
        .when(F.lit(q > 1), F.lit(INF))
        .when(F.col("le") == INF, F.col("prev_le"))
        .when(F.col("prev_le").isNull() & (F.col("le") <= 0), F.col("le"))
        .otherwise(inside)
    )
    return _frame(steps.filter(hit), value)


def _frame(df: DataFrame, value: Column) -> DataFrame:
    return df.select(
        F.lit(None).cast("string").alias("metric"),
        labels_of("gid").alias("labels"),
        F.col("gid").alias("series_id"),
        "ts",
        value.alias("value"),
    )


def heatmap(v: DataFrame) -> DataFrame:
    """``(ts, gid, le, value)``: counts per bucket from cumulative counts."""
    by_le = Window.partitionBy("ts", "gid").orderBy("le")
    own = F.col("value") - F.coalesce(F.lag("value").over(by_le), F.lit(0.0))
    return _bounds(v).select("ts", "gid", "le", own.alias("value"))
