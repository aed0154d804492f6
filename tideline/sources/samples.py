"""Sample tables: batch and streaming reads, federation, recorded series, retention."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.model import COLUMNS, SAMPLE_SCHEMA, label_map, labels_of, merge_labels, rekey, sample_day, vector
from tideline.operators.select import Selector, any_of


def read_samples(spark: SparkSession, path: str, days: tuple[date, date] | None = None):
    """Long sample table ``(metric, labels, ts, value[, series_id, date])``.

    ``days`` prunes partitions.  A table that stores ``series_id`` is read without
    computing keys again.
    """
    df = spark.read.parquet(path)
    if days is not None:
        df = df.filter(F.col("date").between(F.lit(days[0]), F.lit(days[1])))
    return df.select(*COLUMNS) if "series_id" in df.columns else vector(df)


def stream_samples(spark: SparkSession, path: str) -> DataFrame:
    """The same table as a stream of new files."""
    return vector(spark.readStream.schema(SAMPLE_SCHEMA).parquet(path))


def samples_from(df: DataFrame, metric: str, labels: dict[str, Column], ts, value) -> DataFrame:
    """Samples from any event table."""
    return vector(
        df.select(
            label_map(labels).alias("labels"),
            F.col(ts).cast("timestamp").alias("ts") if isinstance(ts, str) else ts.alias("ts"),
            value.cast("double").alias("value"),
        ),
        metric,
    )


def dedupe_samples(v: DataFrame) -> DataFrame:
    """One sample per series and instant (the largest value)."""
    best = v.groupBy("metric", "series_id", "ts").agg(F.max("value").alias("value"))
    return best.withColumn("labels", labels_of("series_id")).select(*COLUMNS)


def federate(v: DataFrame, selectors: Iterable[Selector], add_labels: dict[str, str]):
    """Subset of another server's series in one scan, marked with constant labels."""
    added = F.create_map(*[F.lit(x) for pair in add_labels.items() for x in pair])
    found = v.filter(any_of(selectors))
    return rekey(found.withColumn("labels", merge_labels(F.col("labels"), added)))


def _laid_out(v: DataFrame) -> DataFrame:
    """Stored columns, with each day and stretch of series in one task and sorted.

    A task then writes few files, row groups can be skipped by metric, and keys compress to runs.
    """
    out = v.select("metric", "labels", "series_id", "ts", "value", F.to_date("ts").alias("date"))
    dealt = out.repartitionByRange("date", "metric", "series_id")
    return dealt.sortWithinPartitions("date", "metric", "series_id", "ts")


def write_samples(v: DataFrame, path: str) -> None:
    """Append samples partitioned by day, with their keys."""
    _laid_out(v).write.mode("append").partitionBy("date").parquet(path)


def write_bucketed(v: DataFrame, table: str, path: str, buckets: int) -> None:
    """Append samples to a table in the folder ``path``, partitioned by date and bucketed by series and day.

    Window functions over ``bucketed_samples`` fold a series' samples of a day where they are stored, without
    a shuffle of samples.  A busy series lies in another bucket each day.  Each task writes one bucket.
    """
    placed = v.select("metric", "labels", "series_id", "ts", "value", F.to_date("ts").alias("date"), sample_day("ts").alias("day"))
    dealt = placed.repartition(buckets, "series_id", "day")
    writer = dealt.write.mode("append").partitionBy("date").bucketBy(buckets, "series_id", "day").sortBy("series_id", "ts")
    writer.option("path", path).saveAsTable(table, format="parquet")


def bucketed_samples(spark: SparkSession, table: str, days: tuple[date, date] | None = None) -> DataFrame:
    """Vector of a bucketed table, with the column ``day`` that its buckets go by; ``days`` prunes."""
    df = spark.table(table)
    if days is not None:
        df = df.filter(F.col("date").between(F.lit(days[0]), F.lit(days[1])))
    return df.select(*COLUMNS, "day")


def recorded_rows(v: DataFrame, name: str) -> DataFrame:
    """A rule result as stored rows: under its name, with its record and day."""
    return _laid_out(v.withColumn("metric", F.lit(name))).withColumn("record", F.lit(name))


def write_recorded(v: DataFrame, name: str, path: str) -> None:
    """Write a rule result as a series of its own, below ``record=<name>/date=<day>``.

    A run replaces the days it has rows for, so a repeated run doubles nothing; runs should
    therefore evaluate whole days.
    """
    replacing = recorded_rows(v, name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    replacing.partitionBy("record", "date").parquet(path)


def retain(v: DataFrame, days: int, asof: date) -> DataFrame:
    """Samples of the last ``days`` days; prunes when the table is partitioned by ``date``."""
    oldest = asof - timedelta(days=days)
    if "date" in v.columns:
        return v.filter(F.col("date") >= F.lit(oldest))
    return v.filter(F.col("ts") >= F.lit(oldest).cast("timestamp"))
