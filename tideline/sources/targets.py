"""Target groups: files of ``[{labels, targets}]`` and static lists."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.model import merge_labels, micros

GROUP_SCHEMA = T.StructType(
    [
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("targets", T.ArrayType(T.StringType())),
    ]
)


def expand_groups(groups: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """One row per target; the address becomes the label ``__address__``."""
    rows = groups.select(
        F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"),
        F.explode("targets").alias("address"),
    )
    fixed = [F.lit(x) for pair in (extra or {}).items() for x in pair]
    added = F.create_map(*fixed, F.lit("__address__"), F.col("address"))
    return rows.select(merge_labels(F.col("labels"), added).alias("labels"))


def read_targets(spark: SparkSession, glob: str, extra: dict[str, str] | None = None) -> DataFrame:
    groups = spark.read.schema(GROUP_SCHEMA).option("multiLine", True).json(glob)
    return expand_groups(groups, extra)


def stream_targets(spark: SparkSession, directory: str, out: str, checkpoint: str, every="5m"):
    """Re-read the whole directory at every tick, as a new version of the targets.

    Files that were rewritten, added or deleted show at the next tick.  A version is written in
    parallel to a folder of its own; then one row marks it as whole.  Readers of ``current_targets``
    see marked versions only, so never a part of one.
    """

    def refresh(_batch: DataFrame, _epoch: int) -> None:
        version = time.time_ns() // 1000
        read_targets(spark, f"{directory}/*.json").write.parquet(f"{out}/targets/version={version}")
        mark_version(spark, out, version)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    seconds = micros(every) // 1_000_000
    return (
        ticks.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{seconds} seconds")
    )


def mark_version(spark: SparkSession, out: str, version: int) -> None:
    spark.range(version, version + 1, 1, 1).toDF("version").write.mode("append").parquet(f"{out}/versions")


def current_targets(spark: SparkSession, out: str) -> DataFrame:
    """Targets of the newest version that is whole."""
    newest = spark.read.schema("version long").parquet(f"{out}/versions").agg(F.max("version")).first()[0]
    return spark.read.schema("labels map<string,string>").parquet(f"{out}/targets/version={newest}")


def static_targets(spark: SparkSession, addresses: list[str], labels: dict[str, str]) -> DataFrame:
    groups = spark.createDataFrame([(labels, addresses)], GROUP_SCHEMA)
    return expand_groups(groups)
