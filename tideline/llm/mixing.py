"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get integer numbers of blocks by highest quotients, their shards again by highest
quotients, and each shard takes its blocks in seeded order.  A shard lays its documents out in
seeded order and cuts this line of words into blocks; every block is taken equally often and the
rest of the quota is one more turn through a run of blocks from a seeded start.  So documents are
taken whole, but for those at the ends of a run, and no document more than twice.  The number of
shards follows the size of a source, so none outgrows a task.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stored

BLOCK = 64
SHARD = 1 << 20
SHARE, MOST = 1.5, 2
WEIGHTS = (5, 2, 1)
SEED = 17


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Weights repeat along the sources in order of code points, null last.  All targets together are
    ``share`` of all sizes; a target stops at ``most`` times its source and what is left goes to the
    others by weight.  Sources fill up in order of size over weight, so a running total in that
    order finds the level at which the rest stand.  The windows hold a row per source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("k") % len(weights) + 1)
    ranked = sizes.withColumn("k", (F.row_number().over(in_order) - 1).cast("int")).withColumn("weight", weight)
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "k")
    upto = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.select(
        "*",
        F.coalesce(F.sum("source_size").over(upto), F.lit(0)).alias("full"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).alias("rest"),
        F.sum("source_size").over(whole).alias("all"),
    )
    level = (share * F.col("all") - most * F.col("full")) / F.col("rest")
    # The first source that its share does not fill sets the level for itself and all after it.
    open_ = F.when(level * F.col("weight") < most * F.col("source_size"), level)
    stand = F.first("level", ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, 0))
    cap = most * F.col("source_size").cast("double")
    return filled.withColumn("level", open_).select(
        "source", "source_size", F.coalesce(stand * F.col("weight"), cap).alias("target")
    )


def apportion(df: DataFrame, votes: str, seats: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: ``seats`` (equal within a group ``by``) given to the rows of a group by the
    highest quotients ``votes / (2 k + 1)``; ties go by ``order``.

    Rounding each row's exact share gives the right seats for some total near ``seats``; the
    difference is made good by the next or the last quotients.  Only quotients that can be among
    them are listed, a few per row, so the work follows the rows and not the seats.
    """
    over = Window.partitionBy(*by)
    share = F.coalesce(F.try_divide(F.col(seats) * F.col(votes), F.sum(votes).over(over)), F.lit(0.0))
    near = df.withColumn("__share", share).withColumn("__r", F.floor(F.col("__share") + 0.5).cast("long"))
    near = near.withColumn("__gap", F.col(seats) - F.sum("__r").over(over))
    wide = 1.5 * F.count(F.lit(1)).over(over) * F.col("__share") / F.greatest(F.col(seats), F.lit(1)) + 2
    near = near.withColumn("__wide", F.ceil(wide).cast("long"))
    more = F.col("__gap") > 0
    first = F.when(more, F.col("__r")).otherwise(F.greatest(F.col("__r") - F.col("__wide"), F.lit(0)))
    last = F.when(more, F.col("__r") + F.col("__wide")).otherwise(F.col("__r")) - 1
    steps = F.when((F.col("__gap") != 0) & (last >= first) & (F.col(votes) > 0), F.sequence(first, last))
    listed = near.select("*", F.explode_outer(steps).alias("__k"))
    quotient = F.col(votes) / (2 * F.col("__k") + 1)
    rank = F.row_number().over(
        over.orderBy(F.when(F.col("__gap") > 0, -quotient).otherwise(quotient).asc_nulls_last(), *order, "__k")
    )
    changed = F.col("__k").isNotNull() & (rank <= F.abs("__gap"))
    kept = [F.col(f"`{c}`") for c in df.columns]
    one = listed.select(*kept, "__r", F.when(changed, F.signum("__gap")).otherwise(0).cast("long").alias("__one"))
    return one.groupBy(*kept, "__r").agg(F.sum("__one").alias("__d")).select(
        *kept, (F.col("__r") + F.col("__d")).alias(out)
    )


def _overlap(lo: Column, hi: Column) -> Column:
    """Words of the document's stretch ``[at, at + size)`` inside ``[lo, hi)``."""
    return F.greatest(F.least(F.col("at") + F.col("size"), hi) - F.greatest(F.col("at"), lo), F.lit(0))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        carry: list[str] | None = None, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``__row`` with the columns to carry (every column of ``df``; the key must be among them), ``size``, ``source_size``, ``target`` and ``taken``.

    Sizes are words of the whole text, 0 for null.  Null sources are one source, last in order.
    Order inside a shard comes from a seeded hash of key and text, so reruns agree; equal rows are
    interchangeable.  Rows of size 0 take 0; an empty table gives an empty one.
    """
    sized = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or df.columns]).alias("__row"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`")).alias("__h"),
    )
    rows = stored(sized, "sized")
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    everything = Window.partitionBy()
    seats = F.floor(F.sum("target").over(everything) / block + 0.5).cast("long")
    quotas = apportion(wanted.withColumn("seats", seats), "target", "seats", [], ["source"], "quota")
    shards = F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1)).cast("long")
    sources = stored(
        quotas.select(F.col("source").alias("__s"), "source_size", "target", "quota", shards.alias("shards")), "sources"
    )
    dealt = rows.join(sources, F.col("source").eqNullSafe(F.col("__s"))).withColumn(
        "shard", F.pmod(F.col("__h"), F.col("shards"))
    )
    lines = dealt.groupBy("source", "shard", "quota").agg(F.sum("size").alias("words"))
    lines = apportion(lines, "words", "quota", ["source"], ["shard"], "blocks")
    held = F.ceil(F.col("words") / block).cast("long")
    lines = lines.withColumn("held", held).withColumn("blocks", F.least("blocks", MOST * F.col("held")))
    lines = lines.select(
        F.col("source").alias("__s2"),
        F.col("shard").alias("__shard"),
        F.coalesce(F.expr("try_divide(blocks - blocks % held, held)"), F.lit(0)).cast("long").alias("turns"),
        F.coalesce(F.expr("try_mod(blocks, held)"), F.lit(0)).alias("run"),
        F.coalesce(F.expr(f"pmod(xxhash64({seed}, source, shard), nullif(held, 0))"), F.lit(0)).alias("start"),
        "held",
    )
    lines = stored(lines, "lines")
    same = F.col("source").eqNullSafe(F.col("__s2")) & (F.col("shard") == F.col("__shard"))
    line = Window.partitionBy("source", "shard").orderBy("__h", F.col(f"__row.`{key}`"))
    placed = dealt.join(lines, same).withColumn(
        "at", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    end = F.col("start") + F.col("run")
    once = _overlap(F.col("start") * block, end * block) + _overlap(F.lit(0), (end - F.col("held")) * block)
    return placed.select(
        "__row", "size", "source_size", "target", (F.col("turns") * F.col("size") + once).cast("long").alias("taken")
    )


def repeat_mixed(df: DataFrame) -> DataFrame:
    """The mix as rows: each document as often as the mix takes it, rounded to whole copies."""
    copies = F.floor(F.coalesce(F.try_divide(F.col("taken"), F.col("size")), F.lit(0.0)) + 0.5).cast("int")
    return mix(df).select("__row", F.explode(F.array_repeat(F.lit(0), copies)).alias("__c")).select("__row.*")
