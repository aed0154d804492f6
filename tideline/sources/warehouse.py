"""Scans of date-partitioned and date-sharded warehouse tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(
    spark: SparkSession,
    path: str,
    first: date | None = None,
    last: date | None = None,
    column: str = "date",
) -> DataFrame:
    """Table with its partition column limited by literals, so that files are pruned."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col(column) >= F.lit(first))
    if last is not None:
        df = df.filter(F.col(column) <= F.lit(last))
    return df


def scan_shards(df: DataFrame, days: list[date], column: str = "table_suffix") -> DataFrame:
    """Shards of the given days (suffix ``yyyyMMdd`` kept as a partition column)."""
    return df.filter(F.col(column).isin([d.strftime("%Y%m%d") for d in days]))


def nested(df: DataFrame, **paths: str) -> DataFrame:
    """Project struct paths to columns; only these leaves are read."""
    return df.select(*[F.col(path).alias(name) for name, path in paths.items()])
