"""Reports as gauges: naming contract and hold-until-refresh series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.model import Grid, label_map, vector


def report_to_samples(df: DataFrame, name: str, eval_ts: Column) -> DataFrame:
    """Wide report to long samples.

    ``value_x`` becomes metric ``<name>_x`` and a plain ``value`` the bare name;
    every other column becomes a label.
    """
    values = [c for c in df.columns if c == "value" or c.startswith("value_")]
    others = [c for c in df.columns if c not in values]
    labels = label_map({c: F.col(c) for c in others})
    cells = F.array(
        *[
            F.struct(
                F.lit(name + c.removeprefix("value")).alias("metric"),
                F.col(c).cast("double").alias("value"),
            )
            for c in values
        ]
    )
    rows = df.select(labels.alias("labels"), F.explode(cells).alias("cell"))
    out = rows.select(
        F.col("cell.metric").alias("metric"),
        "labels",
        eval_ts.alias("ts"),
        F.col("cell.value").alias("value"),
    )
    return vector(out.filter(F.col("value").isNotNull()))


def report_series(runs: DataFrame, grid: Grid, instants: DataFrame | None = None) -> DataFrame:
    """Gauge values between refreshes: a row holds until the next run of its report.

    A series that the next run lacks ends there.  Runs are the instants of the report's rows;
    ``instants`` ``(metric, ts)`` names them where a run can be without any row.
    """
    named = runs.select("metric", "ts") if instants is None else instants.select("metric", "ts")
    order = Window.partitionBy("metric").orderBy("ts")  # a row per run
    after = named.distinct().withColumn("_to", F.unix_micros(F.lead("ts").over(order)))
    held = runs.join(after, ["metric", "ts"]).withColumn("_from", F.unix_micros("ts"))
    first = F.greatest(
        F.lit(0), F.ceil((F.col("_from") - F.lit(grid.start)) / F.lit(grid.step))
    )
    last = F.coalesce(
        F.ceil((F.col("_to") - F.lit(grid.start)) / F.lit(grid.step)) - 1, F.lit(grid.last)
    )
    last = F.least(last, F.lit(grid.last))
    held = held.withColumn("_a", first).withColumn("_b", last).filter(F.col("_a") <= F.col("_b"))
    held = held.withColumn("_j", F.explode(F.sequence("_a", "_b")))
    ts = F.timestamp_micros(F.lit(grid.start) + F.col("_j") * F.lit(grid.step))
    return held.select("metric", "labels", "series_id", ts.alias("ts"), "value")
