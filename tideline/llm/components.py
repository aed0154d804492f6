"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (its smallest node) for all nodes of the edges; order and repeats are free.

    Each round hangs neighbours of a node under the smallest node near it, which takes a number of
    rounds that grows with the logarithm of the longest path.  Rounds are cut by checkpoints; only
    a count and a checksum reach the driver.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct()
    pairs, before = cut(pairs), None
    while True:
        mark = tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        both = pairs.union(pairs.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        under = large.groupBy("hi").agg(F.min("lo").alias("m"))
        met = large.join(under, "hi").select(F.explode(F.array(F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("e"))
        pairs = cut(met.select("e.hi", F.col("e.m").alias("lo")).where("hi > lo").distinct())
    stars = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return stars.unionByName(roots)
