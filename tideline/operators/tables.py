"""Unions, ranks, running sums, ordering and grouped reports over warehouse tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.select import Selector, anchored
from tideline.shared import stored


def tagged_union(tables: dict[str, DataFrame], column: str, keep: list | None = None) -> DataFrame:
    """UNION ALL of tables with a literal tag; each input is projected before the union."""
    parts = [
        (df.select(*keep) if keep else df).withColumn(column, F.lit(name))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def mixed(frames: dict[str, DataFrame]) -> DataFrame:
    """Results of several queries in one frame, told apart by ``ref``."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("ref", F.lit(name)) for name, df in frames.items()],
    )


def label_values(v: DataFrame, name: str, selector: Selector | None = None, regex=None):
    """Sorted distinct values of a label, optionally captured by a regex."""
    found = v if selector is None else v.filter(selector.condition())
    text = F.col("labels")[name]
    if regex is not None:
        group = 1 if "(" in regex else 0
        text = F.when(text.rlike(anchored(regex)), F.regexp_extract(text, anchored(regex), group))
    values = found.select(text.alias("value")).filter(F.col("value") != "").distinct()
    return values.orderBy("value")


def _in_order(df: DataFrame, by: str, descending: bool) -> DataFrame:
    """Rows dealt to tasks by ranges of ``by``, with their range ``_range``.

    Rows of equal ``by`` are ordered by a hash of the row (``_tie``), so a value that many rows share
    is dealt to several ranges too.  The ranges are stored, as they come from a sample.
    """
    tied = df.withColumn("_tie", F.xxhash64(*df.columns))
    dealt = tied.repartitionByRange(F.desc(by) if descending else F.asc(by), "_tie")
    return stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def _before(rows: DataFrame, amount: Column, kind: str) -> DataFrame:
    """``_range, _before``: the total of ``amount`` in all earlier ranges.

    The totals, one per task, are added up in one array and joined back to their ranges.
    """
    totals = rows.groupBy("_range").agg(amount.alias("_n"))
    in_order = totals.agg(F.array_sort(F.collect_list(F.struct("_range", "_n"))).alias("_all"))
    sums = F.expr(
        "transform(_all, (x, i) -> named_struct('_at', x._range, '_before',"
        f" aggregate(slice(_all, 1, i), CAST(0 AS {kind}), (a, y) -> CAST(a + coalesce(y._n, 0) AS {kind}))))"
    )
    return in_order.select(F.inline(sums))


def _numbered(rows: DataFrame, amount: Column, kind: str, own: Column, name: str) -> DataFrame:
    placed = rows.join(F.broadcast(_before(rows, amount, kind)), F.col("_range") == F.col("_at"))
    return placed.withColumn(name, own + F.col("_before")).drop("_tie", "_range", "_at", "_before")


def row_number(df: DataFrame, by: str, name: str, descending: bool = False) -> DataFrame:
    """Number of each row in the order of ``by``, from 1, without bringing all rows to one task.

    Rows are counted per range of ``by``; the counts of the ranges before are added to the number
    inside the range.
    """
    order = Window.partitionBy("_range").orderBy(F.desc(by) if descending else F.asc(by), "_tie")
    return _numbered(_in_order(df, by, descending), F.count(F.lit(1)), "bigint", F.row_number().over(order), name)


def neg_row_number(df: DataFrame, by: str, name: str = "le", descending: bool = True) -> DataFrame:
    """Negative row number as text, from the largest ``by`` on."""
    return row_number(df, by, name, descending).withColumn(name, F.format_string("%d", -F.col(name)))


def running_sum(df: DataFrame, column: str, by: str, name: str | None = None) -> DataFrame:
    """Cumulative sum in the order of ``by``, without bringing all rows to one task; nulls add nothing."""
    kind = df.select(F.sum(column)).schema[0].dataType.simpleString()
    order = Window.partitionBy("_range").orderBy(by, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(F.sum(column).over(order), F.lit(0))
    return _numbered(_in_order(df, by, False), F.sum(column), kind, own, name or column)


def share_of(df: DataFrame, column: str, part: list[str], name: str) -> DataFrame:
    total = F.sum(column).over(Window.partitionBy(*part))
    return df.withColumn(name, F.col(column) / total)


def bucket_count(df: DataFrame, column: str, unit: str, by: list, name: str = "total") -> DataFrame:
    """Rows per time bucket and group."""
    bucket = F.date_trunc(unit, column).alias("time")
    return df.groupBy(bucket, *by).agg(F.count(F.lit(1)).alias(name))


def conditional_pivot(sums: dict[str, tuple[Column, Column, float]]) -> list[Column]:
    """``factor * SUM(IF(condition, value, 0))`` columns for one global aggregate."""
    return [
        (F.sum(F.when(cond, value).otherwise(0.0)) * factor).alias(name)
        for name, (cond, value, factor) in sums.items()
    ]


def order_out(df: DataFrame, *by) -> DataFrame:
    return df.orderBy(*by)


def top_by(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(column), *ties)


def limit_out(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """First ``n`` rows in key order, so that the result is deterministic."""
    return df.orderBy(*keys).limit(n)


def approx_quantile(column: str, q: float, accuracy: int = 10_000) -> Column:
    """Approximate quantile that returns an element (mergeable sketch)."""
    return F.percentile_approx(column, q, accuracy)
