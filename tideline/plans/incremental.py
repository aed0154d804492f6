"""Reports refreshed from partial aggregates per date.

A source is partitioned by ``date``.  A refresh compares the files of each date with those of the
last refresh, aggregates the dates whose files changed, and nothing else; a report merges the stored
partials of its dates.  Counts, sums, extremes and means merge exactly, medians and distinct counts
as sketches, so raw rows are read once however often and over whatever range a report is asked for.

A refresh writes the partials of changed dates to a folder of its own, then the list of the partials
that are valid, and at last one row that marks the list as whole.  Readers follow the newest marked
list, so they see the report before or after a refresh, and a refresh that was lost can be repeated.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tideline.model import micros

#: Size of quantile sketches; their rank error is about 2 / size.
SKETCH = 400


@dataclass(frozen=True)
class Measure:
    """A mergeable aggregate: of rows, of stored partials (a column of its name), and its value."""

    first: Callable[[], Column]
    merge: Callable[[Column], Column]
    value: Callable[[Column], Column] = lambda merged: merged


def counted(condition: Column | None = None) -> Measure:
    return Measure(lambda: F.count(F.lit(1)) if condition is None else F.count_if(condition), F.sum)


def summed(column: Column) -> Measure:
    return Measure(lambda: F.sum(column), F.sum)


def lowest(column: Column) -> Measure:
    return Measure(lambda: F.min(column), F.min)


def highest(column: Column) -> Measure:
    return Measure(lambda: F.max(column), F.max)


def averaged(column: Column) -> Measure:
    return Measure(
        lambda: F.struct(F.sum(column).cast("double").alias("s"), F.count(column).alias("n")),
        lambda c: F.struct(F.sum(c["s"]).alias("s"), F.sum(c["n"]).alias("n")),
        lambda c: F.try_divide(c["s"], c["n"]),
    )


def quantile(column: Column, q: float = 0.5) -> Measure:
    """Quantile of a sketch; NaN and null do not count, and without a value it is null."""
    plain = F.when(~F.isnan(column.cast("double")), column.cast("double"))
    return Measure(
        lambda: F.kll_sketch_agg_double(plain, F.lit(SKETCH)),
        F.kll_merge_agg_double,
        lambda c: F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(float(q)))),
    )


def distinct(column: Column) -> Measure:
    return Measure(lambda: F.hll_sketch_agg(column), F.hll_union_agg, F.hll_sketch_estimate)


class PartialReport:
    """A report over the table in the folder ``source``, with its partials in the folder ``path``.

    ``by`` names the groups of the report and ``measures`` its columns, both as expressions of the
    source's rows; ``where`` selects rows.
    """

    def __init__(
        self, spark: SparkSession, source: str, path: str, by: dict[str, Column], measures: dict[str, Measure],
        where: Column | None = None,
    ):
        self.spark, self.source, self.path = spark, source, path.rstrip("/")
        self.by, self.measures, self.where = by, measures, where

    def _files(self) -> DataFrame:
        """``date, mark``: a checksum of names, sizes and times of a date's files.  No file is read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        listed = files.load(self.source).select("path", "modificationTime", "length")
        day = F.to_date(F.regexp_extract("path", "/date=([0-9]{4}-[0-9]{2}-[0-9]{2})/", 1))
        return listed.groupBy(day.alias("date")).agg(F.bit_xor(F.xxhash64("path", "modificationTime", "length")).alias("mark"))

    def _valid(self) -> DataFrame | None:
        """``date, mark, version`` of the newest whole list; None before the first refresh."""
        schema = "version long"
        newest = self.spark.read.schema(schema).parquet(f"{self.path}/versions").agg(F.max("version")).first()[0] if self._begun() else None
        if newest is None:
            return None
        return self.spark.read.schema("date date, mark long, version long").parquet(f"{self.path}/lists/list={newest}")

    def _begun(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def partial(self, rows: DataFrame) -> DataFrame:
        """One row per date and group."""
        wanted = rows if self.where is None else rows.filter(self.where)
        groups = [column.alias(name) for name, column in self.by.items()]
        return wanted.groupBy("date", *groups).agg(*[m.first().alias(name) for name, m in self.measures.items()])

    def refresh(self) -> list[date]:
        """Bring the partials up to date; the dates that were aggregated."""
        now, before = self._files(), self._valid()
        if before is None:
            before = self.spark.createDataFrame([], "date date, mark long, version long")
        version = time.time_ns() // 1000
        compared = now.alias("n").join(before.alias("b"), (F.col("n.date") == F.col("b.date")) & (F.col("n.mark") == F.col("b.mark")), "left")
        valid = compared.select("n.date", "n.mark", F.coalesce("b.version", F.lit(version)).alias("version"))
        # A row per date; files that come while this runs change the mark again for the next refresh.
        lists = valid.collect()
        changed = sorted(r.date for r in lists if r.version == version)
        if not changed and len(lists) == before.count():
            return []
        if changed:
            rows = self.spark.read.parquet(self.source).filter(F.col("date").isin(changed))
            made = self.partial(rows).withColumn("version", F.lit(version))
            made.write.mode("append").partitionBy("version", "date").parquet(f"{self.path}/partials")
        self.spark.createDataFrame(lists, "date date, mark long, version long").coalesce(1).write.parquet(f"{self.path}/lists/list={version}")
        self.spark.range(version, version + 1, 1, 1).toDF("version").write.mode("append").parquet(f"{self.path}/versions")
        return changed

    def partials(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """The valid partials of the dates from ``first`` to ``last``."""
        schema = T.StructType([*self._schema().fields, T.StructField("version", T.LongType())])
        valid = self._valid()
        if valid is None:
            return self.spark.createDataFrame([], schema)
        wanted = valid.select(F.col("date").alias("_date"), F.col("version").alias("_version"))
        if first is not None:
            wanted = wanted.filter(F.col("_date") >= F.lit(first))
        if last is not None:
            wanted = wanted.filter(F.col("_date") <= F.lit(last))
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/partials")
        return stored.join(F.broadcast(wanted), (F.col("date") == F.col("_date")) & (F.col("version") == F.col("_version"))).drop("_date", "_version")

    def _schema(self) -> T.StructType:
        return self.partial(self.spark.read.parquet(self.source)).schema

    def result(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """The report over a range of dates, merged from partials."""
        merged = self.partials(first, last).groupBy(*self.by).agg(*[m.merge(F.col(name)).alias(name) for name, m in self.measures.items()])
        return merged.select(*self.by, *[m.value(F.col(name)).alias(name) for name, m in self.measures.items()])


def refresh_every(reports: list[PartialReport], every: str, checkpoint: str) -> DataStreamWriter:
    """A job that refreshes reports of one tier (``"5m"``, ``"3h"``, ``"24h"``) as long as it runs."""

    def refresh(_batch: DataFrame, _epoch: int) -> None:
        for one in reports:
            one.refresh()

    ticks = reports[0].spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    seconds = micros(every) // 1_000_000
    return ticks.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")


def median_map(report: PartialReport, more_than: int, first: date | None = None, last: date | None = None) -> DataFrame:
    """Approximate medians per place with more than ``more_than`` rows, merged from daily sketches.

    The report is grouped by the place and measures ``value`` (a quantile) and ``value_tests`` (a count).
    """
    found = report.result(first, last).filter((F.col("value_tests") > more_than) & F.col("value").isNotNull())
    for column in report.by:
        found = found.filter(F.col(column).isNotNull())
    return found
