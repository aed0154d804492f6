"""Joins of warehouse reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.model import micros


def coverage(
    left: DataFrame,
    right: DataFrame,
    key: str,
    by: str,
    total: str = "value_total",
    matching: str = "value_matching",
) -> DataFrame:
    """Rows per group and how many of them have a partner.

    Counts are those of the left outer join, in which repeated keys multiply.  Both sides
    are counted per key first, so the pairs of a frequent key are never made.
    """
    mine = left.filter(F.col(key).isNotNull()).groupBy(key, by).agg(F.count(F.lit(1)).alias("_l"))
    theirs = right.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    joined = mine.join(theirs, key, "left")
    return joined.groupBy(by).agg(
        F.sum(F.col("_l") * F.coalesce("_r", F.lit(1))).alias(total),
        F.sum(F.col("_l") * F.coalesce("_r", F.lit(0))).alias(matching),
    )


def zero_fill(all_keys: DataFrame, present: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``present`` plus a zero row for every key combination it lacks."""
    missing = all_keys.select(*keys).distinct().join(present, keys, "left_anti")
    zero = F.lit(0).cast(present.schema[value].dataType)
    return present.select(*keys, value).unionByName(missing.withColumn(value, zero))


def interval_touch_semi(tests: DataFrame, polls: DataFrame, width, key: str = "node") -> DataFrame:
    """Tests whose start or end lies in some poll interval ``[tstart, tend]`` of their node.

    A test that contains a poll without ending in it does not count.  Polls are covered by dyadic
    stretches of time buckets of ``width`` (see ``_covered``) and points look for the stretches
    they lie in: the equi-join key is (node, level, stretch), which spreads a busy node over time,
    and the semi joins list no pairs.  A test is found by its start or, failing that, by its end,
    so each row is kept once and equal rows are all kept.
    """
    cut = _covered(polls, width, key)
    points = tests.select(key, F.explode(F.array("tstart", "tend")).alias("_at"))
    inside = _stretches(points, cut, width).join(cut, _inside(key), "left_semi")
    touched = inside.select(F.col(key).alias("_key"), "_at")

    def at(rows: DataFrame, end: str, how: str) -> DataFrame:
        return rows.join(touched, (rows[key] == touched["_key"]) & (rows[end] == touched["_at"]), how)

    rest = at(tests, "tstart", "left_anti")
    return at(tests, "tstart", "left_semi").unionByName(at(rest, "tend", "left_semi"))


def interval_touch_join(tests: DataFrame, polls: DataFrame, width, key: str = "node") -> DataFrame:
    """Matching (test, poll) pairs, each once; ``polls`` brings ``tstart``, ``tend`` and ``poll_*``."""
    extra = [c for c in polls.columns if c.startswith("poll_")]
    cut = _covered(polls, width, key, extra)
    points = tests.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.col("tstart").alias("at"), F.lit(0).alias("side")),
                F.struct(F.col("tend").alias("at"), F.lit(1).alias("side")),
            )
        ).alias("_p"),
    )
    points = points.withColumn("_at", F.col("_p.at")).withColumn("_side", F.col("_p.side")).drop("_p")
    # a poll touched by both ends is reported for the start only
    both = (F.col("tstart") >= F.col("_s")) & (F.col("tstart") <= F.col("_e"))
    joined = _stretches(points, cut, width).join(cut, _inside(key) & ((F.col("_side") == 0) | ~both))
    return joined.select(*tests.columns, *extra)


def _inside(key: str) -> Column:
    """A point lies in a stretch of the cover and in the poll itself."""
    same = (F.col(key) == F.col("_key")) & (F.col("_level") == F.col("_l")) & (F.col("_stretch") == F.col("_b"))
    return same & (F.col("_at") >= F.col("_s")) & (F.col("_at") <= F.col("_e"))


def _bucket(at: Column, width) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(micros(width)))


#: Stretches of level n are 2^n buckets long.
LEVELS = 40


def _covered(polls: DataFrame, width, key: str, extra: list[str] | None = None) -> DataFrame:
    """Polls cut into dyadic stretches ``(_l, _b)`` of buckets, at most two per level (and six of level 0).

    A stretch belongs to the cover if it lies in the poll and the one twice as long around it does not.
    """
    spread = polls.select(
        F.col(key).alias("_key"),
        F.col("tstart").alias("_s"),
        F.col("tend").alias("_e"),
        *(extra or []),
        _bucket(F.col("tstart"), width).alias("_lo"),
        _bucket(F.col("tend"), width).alias("_hi"),
    )
    cover = F.expr(
        f"flatten(transform(filter(sequence(0, {LEVELS}), n -> shiftleft(1L, n) <= _hi - _lo + 1), n -> filter(array("
        "named_struct('l', n, 'b', shiftright(_lo + shiftleft(1L, n) - 1, n), 'odd', 1),"
        "named_struct('l', n, 'b', shiftright(_hi + 1, n) - 1, 'odd', 0)),"
        " x -> shiftright(_lo + shiftleft(1L, n) - 1, n) <= shiftright(_hi + 1, n) - 1 AND pmod(x.b, 2) = x.odd)))"
    )
    # Two buckets are listed singly: points then need no row of their own for level 1, and polls two more at most.
    single = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.struct(F.lit(0).alias("l"), (2 * F.col("_c.b") + i).alias("b")))
    whole = F.array(F.struct(F.col("_c.l").alias("l"), F.col("_c.b").alias("b")))
    cells = spread.select("_key", "_s", "_e", *(extra or []), F.explode(cover).alias("_c"))
    split = F.explode(F.when(F.col("_c.l") == 1, single).otherwise(whole)).alias("_c")
    return cells.select("_key", "_s", "_e", *(extra or []), split).select(
        "_key", "_s", "_e", *(extra or []), F.col("_c.l").alias("_l"), F.col("_c.b").alias("_b")
    )


def _stretches(points: DataFrame, cut: DataFrame, width) -> DataFrame:
    """Points repeated for the levels that the cover has, of which there are ``LEVELS`` at most."""
    levels = cut.agg(F.collect_set("_l").alias("levels")).scalar()
    leveled = points.withColumn("_level", F.explode(levels))
    numbered = leveled.withColumn("_stretch", _bucket(F.col("_at"), width).cast("long"))
    return numbered.withColumn("_stretch", F.expr("shiftright(_stretch, _level)"))


def flag_in(df: DataFrame, ids: DataFrame, key: str, name: str = "flag") -> DataFrame:
    """``'true'``/``'false'`` by membership of ``key`` in ``ids``."""
    known = ids.select(F.col(key)).distinct().withColumn("_in", F.lit(True))
    joined = df.join(known, key, "left")
    return joined.withColumn(name, F.when(F.col("_in"), "true").otherwise("false")).drop("_in")


def unnest(df: DataFrame, array: str, name: str, outer: bool = False) -> DataFrame:
    explode = F.explode_outer if outer else F.explode
    return df.withColumn(name, explode(array))


def lookup(array: Column, name: str) -> Column:
    """``Value`` of the first element whose ``Name`` fits, NULL without one."""
    found = F.filter(array, lambda m: m["Name"] == name)
    return F.try_element_at(found, F.lit(1))["Value"]
