"""Binary operators between vectors: one-to-one matching and set operators.

Keys are the evaluation instant plus either the canonical label text or, for
``on(...)``, the named labels as plain string columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.floats import arithmetic, ieee_compare
from tideline.model import COLUMNS, Grid, label, label_key, label_map, labels_of
from tideline.operators.vector import constant
from tideline.shared import expanded

COMPARISONS = {"==", "!=", ">", "<", ">=", "<="}


def keyed(v: DataFrame, on: list[str] | None, ignoring: list[str] | None):
    """The vector with match-key columns, and their names."""
    if on is not None:
        names = [f"_on{i}" for i in range(len(on))]
        return v.select("*", *[label(x).alias(n) for x, n in zip(on, names)]), ["ts", *names]
    if ignoring:
        kept = F.map_filter("labels", lambda k, _: ~k.isin(ignoring))
        return v.withColumn("_key", label_key(kept)), ["ts", "_key"]
    return v.withColumn("_key", F.col("series_id")), ["ts", "_key"]


def _paired(left: DataFrame, right: DataFrame, keys: list[str], named: bool) -> DataFrame:
    """Values ``l`` and ``r`` per key of both sides; where a key has a partner, a second series
    under it is an error, not a choice.

    Both sides meet in one aggregation: nothing is joined, and rows repeated per evaluation are
    neither sorted nor shuffled a second time for it.
    """
    carried = [*keys, "value", "metric"] if named else [*keys, "value"]
    both = left.select(*carried, F.lit(True).alias("_left")).unionByName(
        right.select(*carried, F.lit(False).alias("_left"))
    )
    both = both.dropna(subset=keys)  # a missing key has no partner
    ours, theirs = F.col("_left"), ~F.col("_left")
    wanted = [F.count_if(ours).alias("l_n"), F.count_if(theirs).alias("r_n")]
    wanted += [F.first(F.when(side, F.col("value")), ignorenulls=True).alias(x) for side, x in ((ours, "l"), (theirs, "r"))]
    if named:
        wanted.append(F.first(F.when(ours, F.col("metric")), ignorenulls=True).alias("_metric"))
    met = both.groupBy(*keys).agg(*wanted).where("l_n > 0 AND r_n > 0")
    message = F.lit("several series share one match key")
    single = (F.col("l_n") == 1) & (F.col("r_n") == 1)
    checked = F.when(single, F.col("l")).otherwise(F.raise_error(message).cast("double"))
    return met.withColumn("l", checked).drop("l_n", "r_n")


def binop(
    op: str,
    a: DataFrame,
    b: DataFrame,
    on: list[str] | None = None,
    ignoring: list[str] | None = None,
    as_bool: bool = False,
) -> DataFrame:
    """``a op b``; comparisons filter the left side unless ``as_bool``.

    The labels of the result follow from the match key, so only values travel.
    """
    left, keys = keyed(a, on, ignoring)
    right, _ = keyed(b, on, ignoring)
    filters = op in COMPARISONS and not as_bool
    met = _paired(left, right, keys, named=filters)
    lv, rv = F.col("l"), F.col("r")
    name = F.lit(None).cast("string")
    if op not in COMPARISONS:
        value = arithmetic(op, lv, rv)
    elif as_bool:
        value = ieee_compare(op, lv, rv).cast("double")
    else:
        met, value = met.filter(ieee_compare(op, lv, rv)), lv
        name = F.col("_metric")
    if on is None:
        series, labels = F.col("_key"), labels_of("_key")
    else:
        labels = label_map({x: F.col(n) for x, n in zip(on, keys[1:])})
        series = label_key(labels)
    return met.select(
        name.alias("metric"),
        labels.alias("labels"),
        series.alias("series_id"),
        "ts",
        value.alias("value"),
    )


def _keys_only(v: DataFrame, on, ignoring) -> tuple[DataFrame, list[str]]:
    right, keys = keyed(v, on, ignoring)
    return right.select(*keys).distinct(), keys


def v_and(a: DataFrame, b: DataFrame, on=None, ignoring=None) -> DataFrame:
    left, keys = keyed(a, on, ignoring)
    return left.join(expanded(_keys_only(b, on, ignoring)[0]), keys, "left_semi").select(*COLUMNS)


def v_unless(a: DataFrame, b: DataFrame, on=None, ignoring=None) -> DataFrame:
    left, keys = keyed(a, on, ignoring)
    return left.join(expanded(_keys_only(b, on, ignoring)[0]), keys, "left_anti").select(*COLUMNS)


def v_or(a: DataFrame, b: DataFrame, on=None, ignoring=None) -> DataFrame:
    return a.select(*COLUMNS).unionByName(v_unless(b, a, on, ignoring))


def v_or_all(*vectors: DataFrame) -> DataFrame:
    """``a or b or c …`` on all labels.

    The earliest operand that has a series at an instant provides it, found in one
    shuffle instead of a chain of anti joins.
    """
    ranked = None
    for rank, v in enumerate(vectors):
        part = v.select(*COLUMNS, F.lit(rank).alias("_rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    # at most one row per operand and metric meets here
    same = Window.partitionBy("ts", "series_id")
    best = ranked.withColumn("_best", F.min("_rank").over(same))
    return best.filter(F.col("_rank") == F.col("_best")).select(*COLUMNS)


def or_default(v: DataFrame, k: float, grid: Grid) -> DataFrame:
    """``v or vector(k)``."""
    return v_or(v, constant(grid.instants(v.sparkSession), k))
