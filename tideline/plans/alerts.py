"""Alert lifecycle in batch: hold time, intervals, routing, grouping, inhibition."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.model import label, label_key, micros
from tideline.operators.matching import v_or, v_unless
from tideline.operators.select import Matcher, sel
from tideline.operators.vector import compare

INSTANCE = ["alert", "series_id"]


def alert_states(active: DataFrame, hold, step) -> DataFrame:
    """Each active evaluation with the start of its unbroken run and its state.

    An instance has one row per evaluation, so a window over it is bounded by the grid.
    """
    order = Window.partitionBy(*INSTANCE).orderBy("ts")
    us = F.unix_micros("ts")
    before = F.lag(us).over(order)
    begins = before.isNull() | (us - before > micros(step))
    marked = active.withColumn("_begin", F.when(begins, F.col("ts")))
    since = F.last("_begin", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    held = marked.withColumn("since", since).drop("_begin")
    firing = us - F.unix_micros("since") >= micros(hold)
    return held.withColumn("state", F.when(firing, "firing").otherwise("pending"))


def alert_intervals(states: DataFrame, step, end=None, resolve_timeout=None) -> DataFrame:
    """One row per firing run: ``fired_at`` and ``resolved_at``.

    A run ends one step after its last active evaluation, or ``resolve_timeout`` after it
    when the sender just goes quiet.  Runs that reach ``end`` are still open (NULL).
    """
    quiet = micros(step if resolve_timeout is None else resolve_timeout)
    runs = states.groupBy(*INSTANCE, "since").agg(
        F.min(F.when(F.col("state") == "firing", F.col("ts"))).alias("fired_at"),
        F.max("ts").alias("last_at"),
    )
    resolved = F.timestamp_micros(F.unix_micros("last_at") + F.lit(quiet))
    if end is not None:
        resolved = F.when(F.unix_micros("last_at") + F.lit(micros(step)) <= F.lit(micros(end)), resolved)
    return (
        runs.filter(F.col("fired_at").isNotNull())
        .withColumn("resolved_at", resolved)
        .withColumn("labels", F.from_json("series_id", "map<string,string>"))
    )


@dataclass(frozen=True)
class Route:
    """Node of the routing tree."""

    receiver: str
    matchers: tuple[Matcher, ...] = ()
    proceed: bool = False
    routes: tuple[Route, ...] = ()


def _all(matchers: tuple[Matcher, ...]) -> Column:
    return sel(None, *matchers).condition()


def receivers(node: Route) -> Column:
    """Receivers of an alert: the first matching child and, while it says so, the next ones."""
    empty = F.array().cast("array<string>")
    found, stopped = empty, F.lit(False)
    for child in node.routes:
        taken = _all(child.matchers) & ~stopped
        found = F.concat(found, F.when(taken, receivers(child)).otherwise(empty))
        if not child.proceed:
            stopped = stopped | taken
    if not node.routes:
        return F.array(F.lit(node.receiver))
    return F.when(F.size(found) == 0, F.array(F.lit(node.receiver))).otherwise(found)


def route(alerts: DataFrame, tree: Route) -> DataFrame:
    return alerts.withColumn("receiver", F.explode(receivers(tree)))


def discard(routed: DataFrame, receiver: str = "null") -> DataFrame:
    return routed.filter(F.col("receiver") != receiver)


def send_resolved(routed: DataFrame, wanted: dict[str, bool], resolved: Column) -> DataFrame:
    """Drop resolved rows of receivers that only want firing alerts."""
    muted = [name for name, on in wanted.items() if not on]
    return routed.filter(~(resolved & F.col("receiver").isin(muted))) if muted else routed


@dataclass(frozen=True)
class Inhibition:
    """While a source fires, targets with equal values of ``equal`` are silent."""

    source: tuple[Matcher, ...]
    target: tuple[Matcher, ...]
    equal: tuple[str, ...] = field(default_factory=tuple)


def inhibit(firing: DataFrame, rules: list[Inhibition]) -> DataFrame:
    """Firing alerts ``(ts, labels, …)`` without the inhibited ones.

    Missing labels are equal to each other.  An alert that is source and target of a
    rule is silenced only by alerts that are not its target as well.
    """
    out = firing
    for rule in rules:
        names = [f"_e{i}" for i in range(len(rule.equal))]
        keys = [label(x).alias(n) for x, n in zip(rule.equal, names)]
        as_source, as_target = _all(rule.source), _all(rule.target)
        sources = (
            firing.filter(as_source)
            .select(F.col("ts").alias("_ts"), *keys, as_target.alias("_both"))
            .distinct()
        )
        sources = sources.select("_ts", *[F.col(n).alias(f"{n}s") for n in names], "_both")
        targets = out.select("*", *keys, as_target.alias("_is"), as_source.alias("_also"))
        cond = (F.col("ts") == F.col("_ts")) & F.col("_is") & ~(F.col("_also") & F.col("_both"))
        for n in names:
            cond = cond & (F.col(n) == F.col(f"{n}s"))
        kept = targets.join(sources, cond, "left_anti")
        out = kept.select(*firing.columns)
    return out


def group_alerts(routed: DataFrame, by: list[str]) -> DataFrame:
    """Give each alert its notification group; the rows of a group stay distributed."""
    wanted = F.map_filter("labels", lambda k, _: k.isin(by) if by else F.lit(False))
    return routed.withColumn("group_key", label_key(wanted))


def summarise_group(grouped: DataFrame, keys: list[str], column: str = "labels") -> DataFrame:
    """Per group the number of alerts and the labels all of them share."""
    size = grouped.groupBy(*keys).agg(F.count(F.lit(1)).alias("alerts"))
    cells = grouped.select(*keys, F.explode(column).alias("name", "text"))
    shared = cells.groupBy(*keys, "name").agg(
        F.count(F.lit(1)).alias("_n"), F.min("text").alias("_lo"), F.max("text").alias("_hi")
    )
    joined = shared.join(size, keys).filter(
        (F.col("_n") == F.col("alerts")) & (F.col("_lo") == F.col("_hi"))
    )
    # at most one entry per label name
    common = joined.groupBy(*keys).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "_lo"))))).alias(
            "common"
        )
    )
    filled = size.join(common, keys, "left")
    return filled.withColumn("common", F.coalesce("common", F.lit("{}")))


def down_or_missing(ev, selector) -> DataFrame:
    """``x == 0 or absent(x)``."""
    return v_or(compare(ev.at(selector), "==", 0), ev.absent(selector))


def unless_maintenance(v: DataFrame, maintenance: DataFrame, on: list[str]) -> DataFrame:
    """Suppress while the maintenance flag of the same site or machine is 1."""
    return v_unless(v, compare(maintenance, "==", 1), on=on)


def alert_rollup(intervals: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """Alerts that started firing per time bucket and label."""
    names = [label(x).alias(x) for x in by]
    return intervals.groupBy(F.date_trunc(unit, "fired_at").alias("time"), *names).agg(
        F.count(F.lit(1)).alias("alerts")
    )
