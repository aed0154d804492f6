"""Sinks of streaming jobs.

Each micro-batch replaces its own directory, so replays are safe.  Directories lie below the run,
the name of a checkpoint: a new checkpoint numbers its batches from 0 again and must not replace
the rows of an older one.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def run_of(checkpoint: str) -> str:
    """Name of the run that belongs to a checkpoint folder."""
    return sha256(str(checkpoint).encode()).hexdigest()[:16]


def batch_writer(path: str, run: str, key: str = "batch"):
    """``foreachBatch`` function that writes a batch under ``run=<run>/<key>=<batch id>/date=<day>``."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").partitionBy("date").parquet(f"{path}/run={run}/{key}={epoch}")

    return write


def _sink(rows: DataFrame, path: str, checkpoint: str, run: str | None) -> DataStreamWriter:
    write = batch_writer(path, run or run_of(checkpoint))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def recorded_sink(v: DataFrame, path: str, checkpoint: str, run: str | None = None) -> DataStreamWriter:
    """Write recorded samples.  Give each new checkpoint a folder of its own, or a ``run``."""
    rows = v.select("metric", "labels", "ts", "value", F.to_date("ts").alias("date"))
    return _sink(rows, path, checkpoint, run)


def notification_sink(notes: DataFrame, path: str, checkpoint: str, run: str | None = None) -> DataStreamWriter:
    """Write notification rows, once per (group, batch)."""
    return _sink(notes.withColumn("date", F.to_date("sent_at")), path, checkpoint, run)
