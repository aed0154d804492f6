"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from functools import reduce
from sys import getsizeof

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.shared import cut, fresh_path, shared_dir, stored

__all__ = ["cut", "fresh_path", "shared_dir", "stored"]

#: ASCII white space between words: blank, tab, line feed, vertical tab, form feed, return.
WHITE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fewer groups than this can each hold more than this part of all rows; those are broadcast.
HOT = 20_000
#: One in so many documents is held out of training, by ``crc32`` of its id as text.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out; one without an id has no checksum and is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def sample_keys(df: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """``group, key`` of at most ``limit`` keys per group: those of the smallest hashes.

    A first cut by hash, from the number of rows per group, lets about four times as many through;
    only these are ranked, however large a group is.  The few keys are stored, so Spark knows their
    size when it joins texts to them, and texts are read twice rather than shuffled.
    """
    named = df.select(group, key).where(F.col(group).isNotNull() & F.col(key).isNotNull())
    sizes = stored(named.groupBy(group).agg(F.count(F.lit(1)).alias("__n")), "sizes")
    share = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / float(1 << 40)
    some = named.join(sizes, group).where(share * F.col("__n") < 4 * limit).select(group, key).distinct()
    rank = F.row_number().over(Window.partitionBy(group).orderBy(share, key))
    return stored(some.withColumn("__r", rank).where(F.col("__r") <= limit).drop("__r"), "sample")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key and its number of rows ``size``.

    A group of more than ``total / HOT`` rows would crowd a task of a shuffled join.  There are fewer
    than ``HOT`` of these, so they are broadcast; only rows of smaller groups are shuffled.  Both
    frames are read twice and should be stored; ``total`` is at least the number of rows.  Null keys
    are a group.  The columns of ``groups`` must have other names than those of ``rows``, but for the keys.
    """
    named = groups.select(*[F.col(c).alias(f"__k_{c}" if c in keys else c) for c in groups.columns])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) if _nullable(groups, k) else F.col(k) == F.col(f"__k_{k}") for k in keys])
    crowded = F.col(size) * HOT > total
    hot, made = F.broadcast(named.where(crowded)), [F.col(c) for c in groups.columns if c not in keys]
    at_once = rows.join(hot, same).select(*rows.columns, *made)
    others = rows.join(hot, same, "left_anti").join(named.where(~crowded), same).select(*rows.columns, *made)
    return at_once.unionByName(others)


def _nullable(df: DataFrame, column: str) -> bool:
    return df.schema[column].nullable


class Memo(dict):
    """Results of a function by key, bounded: two generations of ``limit`` entries at most.

    Look-ups are plain dictionary look-ups; only misses reach Python code.  Dropping the older
    generation costs recomputation, never a different result.
    """

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit, self.held, self.old = fn, limit, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self._keep(key, value, 1)
        return value

    def _keep(self, key, value, size: int) -> None:
        if self.held + size > self.limit and self:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size


class TextMemo(Memo):
    """A memo of texts whose ``limit`` is in bytes; texts of over ``LONGEST`` characters, which
    seldom come again, are worked out each time."""

    LONGEST = 64
    #: Bytes of an entry beside its key and value.
    ENTRY = 100

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.fn(key)
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        self._keep(key, value, self.ENTRY + getsizeof(key) + getsizeof(value))
        return value
