"""Exact quantiles of groups of any size.

Equal values are counted first, with partial sums before the shuffle.  Totals per range
of values, of which a group has a bounded number, tell the range that holds the wanted
rank; only the values of that range are sorted, and ranges lie in different tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.floats import INF
from tideline.shared import expanded

#: Ranges per doubling of a value.
RANGES = 1024


def value_range(value: Column) -> Column:
    """Number of a value's range; larger values never lie in a lower range, NaN in the last."""
    size = F.floor(F.log2(F.nullif(F.abs(value), F.lit(0.0))) * RANGES) + (1 << 24)
    return (
        F.when(F.isnan(value), F.lit(1 << 30))
        .when(F.abs(value) == INF, F.signum(value).cast("long") * (1 << 29))
        .when(value == 0, F.lit(0))
        .otherwise(F.signum(value).cast("long") * size)
        .cast("long")
    )


def exact_quantile(
    df: DataFrame, keys: list[str], value: str, q: float, weight: str | None = None
) -> DataFrame:
    """Linearly interpolated ``q`` quantile of ``value`` per group, in a column of that name.

    Groups with null keys are groups like others.  ``weight`` counts a row several times.
    """
    if q < 0 or q > 1 or math.isnan(q):
        edge = F.lit(q if math.isnan(q) else math.copysign(INF, q))
        return df.select(*keys).distinct().withColumn(value, edge)

    times = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(*keys, F.col(value).alias("_v"), times.alias("_t")).filter("_v IS NOT NULL")
    counted = rows.groupBy(*keys, "_v").agg(F.sum("_t").alias("_c"))
    counted = counted.withColumn("_r", value_range(F.col("_v")))

    group = Window.partitionBy(*keys)
    upto = group.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    totals = counted.groupBy(*keys, "_r").agg(F.sum("_c").alias("_c"))
    rank = F.lit(q) * (F.sum("_c").over(group) - 1)
    placed = totals.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_r").alias("_range"),
        (F.sum("_c").over(upto) - F.col("_c")).alias("_before"),
        F.sum("_c").over(upto).alias("_upto"),
        rank.alias("_rank"),
    )
    holds = (F.col("_before") <= F.ceil("_rank")) & (F.col("_upto") > F.floor("_rank"))
    held = placed.filter(holds).drop("_upto")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    near = counted.join(expanded(held), reduce(Column.__and__, same, F.col("_r") == F.col("_range")))

    inside = Window.partitionBy(*keys, "_r").orderBy("_v")
    cum = F.col("_before") + F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    picked = near.withColumn("_cum", cum).groupBy(*keys).agg(
        F.min(F.when(F.col("_cum") > F.floor("_rank"), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_cum") > F.ceil("_rank"), F.col("_v"))).alias("_hi"),
        F.first(F.col("_rank") - F.floor("_rank")).alias("_w"),
    )
    return picked.select(
        *keys,
        F.when(F.col("_w") == 0, F.col("_lo"))
        .otherwise(F.col("_lo") * (1 - F.col("_w")) + F.col("_hi") * F.col("_w"))
        .alias(value),
    )
