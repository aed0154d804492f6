"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a folder of our own where it is unset.

    Executors on other machines do not see a folder of the driver's, so there the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def expanded(df: DataFrame) -> DataFrame:
    """A side of a join whose rows were repeated, for evaluations or windows, and is sorted and merged.

    Spark takes its size for that of the rows before they were repeated, and would send a table that is
    many times as large whole through the driver.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, cutting the lineage (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: cuts lineage, keeps column pruning,
    and lets Spark plan later joins from the table's measured size."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
