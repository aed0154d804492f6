"""Data model: labelled samples, canonical label keys and evaluation grids.

A *vector* is a DataFrame ``(metric, labels, series_id, ts, value)``.  ``labels``
is a map, which Spark cannot join on, so each row carries ``series_id``: the
labels as JSON text with sorted keys and without empty values.  The labels are a
function of ``series_id``; shuffles move only the text and rebuild the map.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = "map<string,string>"
COLUMNS = ["metric", "labels", "series_id", "ts", "value"]
SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def build_session(app: str = "tideline", **conf: str) -> SparkSession:
    """Session with the settings the library relies on: UTC, ANSI, adaptive plans."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def micros(value: timedelta | datetime | str | int | float) -> int:
    """Microseconds of a duration (``timedelta``, seconds, ``"5m"``) or of an instant."""
    if isinstance(value, timedelta):
        return (value.days * 86400 + value.seconds) * 1_000_000 + value.microseconds
    if isinstance(value, datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        return micros(aware - datetime(1970, 1, 1, tzinfo=timezone.utc))
    if isinstance(value, str):
        unit = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[value[-1]]
        return round(float(value[:-1]) * unit * 1_000_000)
    return round(value * 1_000_000)


@dataclass(frozen=True)
class Grid:
    """Evaluation instants ``start, start+step, … <= end`` in microseconds."""

    start: int
    end: int
    step: int

    @classmethod
    def of(cls, start, end, step) -> Grid:
        return cls(micros(start), micros(end), micros(step))

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step

    def instants(self, spark: SparkSession) -> DataFrame:
        """One row per evaluation instant, generated in parallel."""
        ids = spark.range(self.start, self.start + self.last * self.step + 1, self.step)
        return ids.select(F.timestamp_micros("id").alias("ts"))


def instant_literal(us: int) -> Column:
    return F.timestamp_micros(F.lit(us))


DAY = 86_400_000_000


def sample_day(ts: Column | str) -> Column:
    """Number of the day that ends with or after an instant: midnight belongs to the day before, as
    windows and slices are closed on the right."""
    return F.floor((F.unix_micros(ts) - 1) / F.lit(DAY)).cast("int")


def clean_labels(labels: Column) -> Column:
    """Drop absent and empty labels: an empty label equals a missing one."""
    return F.map_filter(labels, lambda _, v: F.coalesce(v, F.lit("")) != "")


def label_key(labels: Column) -> Column:
    """Canonical text of a label map."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(clean_labels(labels)))))


def labels_of(series_id: Column | str) -> Column:
    return F.from_json(series_id, LABELS)


def label(name: str) -> Column:
    """Value of a label, with '' when it is missing."""
    if name == "__name__":
        return F.coalesce(F.col("metric"), F.lit(""))
    return F.coalesce(F.col("labels")[name], F.lit(""))


def label_map(pairs: dict[str, Column]) -> Column:
    """Label map of named string columns."""
    if not pairs:
        return F.from_json(F.lit("{}"), LABELS)
    flat = [part for name, value in pairs.items() for part in (F.lit(name), value.cast("string"))]
    return clean_labels(F.create_map(*flat))


def vector(df: DataFrame, metric: str | Column | None = None) -> DataFrame:
    """Give a ``(labels, ts, value)`` frame its metric name and canonical key."""
    if metric is None:
        name = F.col("metric") if "metric" in df.columns else F.lit(None).cast("string")
    else:
        name = F.lit(metric) if isinstance(metric, str) else metric
    return df.select(
        name.alias("metric"),
        clean_labels(F.col("labels")).alias("labels"),
        label_key(F.col("labels")).alias("series_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").cast("double").alias("value"),
    )


def rekey(v: DataFrame) -> DataFrame:
    """Recompute keys after the labels of a vector changed."""
    return vector(v)


def merge_labels(base: Column, winner: Column) -> Column:
    """Union of two maps; ``winner`` decides shared keys (``map_concat`` raises on them)."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(winner, k))
    return F.map_concat(kept, winner)


def drop_name(v: DataFrame) -> DataFrame:
    return v.withColumn("metric", F.lit(None).cast("string"))
