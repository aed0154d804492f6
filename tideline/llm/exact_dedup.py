"""Exact dedup against a persistent index of text digests.

The index is a table ``(digest, keep_id)`` bucketed and sorted by digest, with one row per distinct
text ever loaded.  A load is reduced to one row per digest, set against the index by a sort-merge
anti-join whose index side is neither shuffled nor held in memory, and only the digests that the
index lacks are appended, each task writing one bucket.  DataFrame functions only.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import WHITE, fresh_path, join_groups, stored


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


class DigestIndex:
    """The digests in the folder ``path``, which outlives the session.

    The number of buckets is fixed when the folder is new (``buckets``, else the session's number of
    shuffle partitions) and read from it later, so every session sees the same table.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.name = spark, f"digest_index_{sha256(path.encode()).hexdigest()[:20]}"
        made = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        notes = f"{path.rstrip('/')}/layout"
        spark.range(1).select(F.lit(made).alias("buckets")).write.mode("ignore").parquet(notes)
        self.buckets = spark.read.schema("buckets int").parquet(notes).first().buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path.rstrip('/')}/digests'"
        )
        spark.catalog.refreshTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, firsts: DataFrame) -> DataFrame:
        """The rows of ``firsts``, one per digest, whose digest the index lacks."""
        return firsts.join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, firsts: DataFrame) -> None:
        """Add what the index lacks.  Adding the same rows again adds nothing, so a load that failed
        half-way can be run again."""
        self.unseen(firsts).select("digest", "keep_id").write.insertInto(self.name)


def digests(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, keep_id, digest`` of every row, stored: its number, id, and the SHA-256 of its normalised text."""
    digest = F.unhex(F.sha2(normalised(F.col(f"`{text}`")), 256))
    return stored(df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").alias("id"), digest.alias("digest")), "digests")


def firsts(rows: DataFrame) -> DataFrame:
    """``digest, keep_id, first_row, group_size``: of the rows of a digest that of the smallest id,
    nulls last, then of the smallest number.  Partial results meet per digest, however many rows it has."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    found = rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size"))
    return found.select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("first_row"), "group_size")


def deduplicate(loads: list[DataFrame], index: DigestIndex, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for every row of all loads, under the name of the id column.

    Loads are appended to the index in their order.  ``keep_id`` is the id under which the index has
    the text: of equal texts within a load the smallest id, nulls last, and before that the earlier
    load.  ``kept`` marks one row per text that was new; of equal ids, one.  A row that comes again
    under the id that the index has is the same row loaded again and stays kept, so a load can be
    repeated.  ``group_size`` counts the rows of these loads.  Null texts are empty texts; rows
    without id are rows like others; other columns are not looked at; empty loads add nothing.
    """
    read = [digests(load, id, text) for load in loads]
    numbered = [rows.withColumn("load", F.lit(k)) for k, rows in enumerate(read)]
    for rows in read:
        index.append(firsts(rows))
    rows = numbered[0]
    for more in numbered[1:]:
        rows = rows.unionByName(more)
    mine = rows.groupBy("digest").agg(
        F.min(F.struct("load", F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    known = mine.join(index.rows().hint("merge"), "digest")
    same = F.col("first.id").eqNullSafe(F.col("keep_id"))
    groups = stored(
        known.select(
            "digest", "keep_id", "group_size", F.when(same, F.col("first.load")).alias("keep_load"), F.when(same, F.col("first.row")).alias("keep_row")
        ),
        "groups",
    )
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    kept = (F.col("load") == F.col("keep_load")) & (F.col("row") == F.col("keep_row"))
    return join_groups(rows, groups, ["digest"], "group_size", total).select(
        F.col("id").alias(id), "keep_id", "group_size", F.coalesce(kept, F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def two_loads(df: DataFrame, id: str = "doc_id") -> list[DataFrame]:
    """A table as two loads: the lower half of the range of its ids, then all other rows."""
    ends = df.agg(F.min(id).alias("lo"), F.max(id).alias("hi")).first()
    middle = 0 if ends.lo is None else (ends.lo + ends.hi) // 2
    early = F.coalesce(F.col(id) <= middle, F.lit(False))
    return [df.where(early), df.where(~early)]


def fresh_index(spark: SparkSession, id_type: str = "bigint") -> DigestIndex:
    """An empty index of its own in the shared folder."""
    return DigestIndex(spark, fresh_path(spark, "digest-index"), id_type)
