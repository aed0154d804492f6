"""Element-wise operators on vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.floats import NAN, arithmetic, ieee_compare
from tideline.model import (
    COLUMNS,
    Grid,
    drop_name,
    label_key,
    label_map,
)
from tideline.operators.rangefn import over_time
from tideline.operators.select import Selector


def map_value(v: DataFrame, value: Column) -> DataFrame:
    """Replace the value; a computed value no longer carries the metric name."""
    return drop_name(v.withColumn("value", value.cast("double")))


def arith(v: DataFrame, op: str, k: float) -> DataFrame:
    return map_value(v, arithmetic(op, F.col("value"), F.lit(float(k))))


def rarith(k: float | Column, op: str, v: DataFrame) -> DataFrame:
    left = k if isinstance(k, Column) else F.lit(float(k))
    return map_value(v, arithmetic(op, left, F.col("value")))


def neg(v: DataFrame) -> DataFrame:
    return map_value(v, -F.col("value"))


def vabs(v: DataFrame) -> DataFrame:
    return map_value(v, F.abs("value"))


def eval_seconds() -> Column:
    """``time()``: the evaluation instant in seconds."""
    return F.unix_micros("ts") / 1_000_000.0


def age(v: DataFrame) -> DataFrame:
    """``time() - v``."""
    return map_value(v, eval_seconds() - F.col("value"))


def remaining(v: DataFrame) -> DataFrame:
    """``v - time()``."""
    return map_value(v, F.col("value") - eval_seconds())


def compare(v: DataFrame, op: str, k: float, as_bool: bool = False) -> DataFrame:
    """Keep samples that satisfy the comparison, or turn it into 0/1."""
    cond = ieee_compare(op, F.col("value"), F.lit(float(k)))
    return map_value(v, cond.cast("double")) if as_bool else v.filter(cond)


def constant(instants: DataFrame, value: Column | float, labels: dict[str, str] | None = None):
    """The same value at each instant, as a vector."""
    mapped = label_map({k: F.lit(x) for k, x in (labels or {}).items()})
    column = value if isinstance(value, Column) else F.lit(float(value))
    return instants.select(
        F.lit(None).cast("string").alias("metric"),
        mapped.alias("labels"),
        label_key(mapped).alias("series_id"),
        "ts",
        column.cast("double").alias("value"),
    )


def scalar(v: DataFrame, instants: DataFrame) -> DataFrame:
    """``(ts, value)``: the only sample of each instant, NaN when there is not exactly one."""
    single = v.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("only"))
    value = F.when(F.col("n") == 1, F.col("only")).otherwise(F.lit(NAN))
    return instants.join(single, "ts", "left").select("ts", value.alias("value"))


def with_scalar(v: DataFrame, op: str, s: DataFrame, reverse: bool = False) -> DataFrame:
    """Arithmetic between a vector and a scalar of the same grid."""
    joined = v.join(s.withColumnRenamed("value", "k"), "ts")
    left, right = (F.col("k"), F.col("value")) if reverse else (F.col("value"), F.col("k"))
    return map_value(joined, arithmetic(op, left, right)).select(*COLUMNS)


def absent_vector(v: DataFrame, instants: DataFrame, labels: dict[str, str] | None = None):
    """1 at each instant at which ``v`` has no sample."""
    return constant(instants.join(v.select("ts").distinct(), "ts", "left_anti"), 1.0, labels)


def absent(v: DataFrame, selector: Selector, instants: DataFrame) -> DataFrame:
    """``absent(selector)`` on an aligned vector; labels come from equality matchers."""
    return absent_vector(v.filter(selector.condition()), instants, selector.equal_labels())


def absent_over_time(samples: DataFrame, selector: Selector, d, grid: Grid) -> DataFrame:
    """1 where no sample of the selector lies in the trailing window."""
    # One anonymous series is enough to know whether anything was present.
    found = samples.filter(selector.condition()).select(
        F.lit(None).cast("string").alias("metric"),
        F.lit("{}").alias("series_id"),
        "ts",
        F.lit(1.0).alias("value"),
    )
    present = over_time(found, "count", d, grid)
    return absent_vector(present, grid.instants(samples.sparkSession), selector.equal_labels())
