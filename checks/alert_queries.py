"""Rules, alert lifecycle and notifications."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.registry import (
    COUNTER,
    GAUGE,
    GRID,
    HOUR,
    HOURLY,
    LO,
    LO_S,
    MAINT,
    N,
    T,
    UP,
    counter_cte,
    instant_cte,
    latest,
    out,
    query,
    seconds,
    windowed,
)
from tideline.model import label, vector
from tideline.operators import rangefn as R
from tideline.operators.aggregate import agg
from tideline.operators.select import eq, ne, rx, sel
from tideline.operators.vector import compare
from tideline.plans import alerts as X
from tideline.plans import rules
from tideline.plans.evaluate import AlertRule, Evaluator, RecordingRule, eval_rule, eval_rules
from tideline.sources.samples import recorded_rows, samples_from

DAY = 24 * HOUR
UPS = f"{UP}, {windowed(HOUR)}, {latest('instance, site')}"
MS = f"{MAINT}, {windowed(HOUR, src='m', name='mw')}, {latest('site', 'mw', 'mi')}"
MAINT_ON = "SELECT site, j FROM mi WHERE value = 1"

UP_SEL = sel("up")
MAINT_SEL = sel("maint")
VALUE = sel("event_value")
BUSY = sel("busy_seconds_total")


def evaluator(t) -> Evaluator:
    samples = t.gauge.unionByName(t.up).unionByName(t.maint).unionByName(t.counter)
    return Evaluator(samples, HOURLY, lookback="1h")


def rule(name: str, sql: str, expr, *shown: str, digits: int = 6):
    query(name, sql)(lambda t: out(expr(evaluator(t)), *shown, digits=digits))


GI = instant_cte(GAUGE, "type, usr")
CX = f"{COUNTER}, {counter_cte('type', 6 * HOUR)}"

rule("rule_gauge", f"WITH {UPS} SELECT instance, site, {T}, value FROM i WHERE value = 0", rules.gauge(UP_SEL, "==", 0), "instance", "site")
rule(
    "x16_down_or_missing",
    f"WITH {UPS}, {GRID}, a AS (SELECT * FROM i WHERE site = '3') SELECT instance, site, {T}, value FROM a WHERE value = 0"
    f" UNION ALL SELECT '', '3', {T}, 1.0 FROM g WHERE j NOT IN (SELECT j FROM a)",
    rules.down_or_missing(sel("up", eq("site", "3"))),
    "instance",
    "site",
)
rule(
    "rule_missing",
    f"WITH {GI}, {GRID} SELECT 'error' AS type, {T}, 1.0::DOUBLE AS value FROM g WHERE j NOT IN (SELECT j FROM i WHERE type = 'error')"
    f" UNION ALL SELECT 'view', {T}, 1.0 FROM g WHERE j NOT IN (SELECT j FROM i WHERE type = 'view')",
    rules.missing(sel("event_value", eq("type", "error")), sel("event_value", eq("type", "view"))),
    "type",
)
rule(
    "rule_restarts",
    f"WITH {GAUGE}, {windowed(DAY)}, c AS (SELECT *, lag(value) OVER (PARTITION BY type, usr, j ORDER BY us) AS pv FROM w)"
    f" SELECT type, usr, {T}, CAST(count(*) FILTER (value < pv) AS DOUBLE) AS value FROM c GROUP BY type, usr, j HAVING count(*) FILTER (value < pv) > 1",
    rules.restarts(VALUE, "1d", 1),
    "type",
    "usr",
)
rule(
    "rule_stale",
    f"WITH {GI} SELECT type, usr, {T}, round({LO_S} + j * 3600 - value, 6) AS value FROM i WHERE {LO_S} + j * 3600 - value > 1706000000",
    rules.stale(VALUE, 1706000000),
    "type",
    "usr",
)
rule(
    "rule_expiring",
    f"WITH {GI} SELECT type, {T}, round(min((value - ({LO_S} + j * 3600)) / 86400), 6) AS value FROM i GROUP BY type, j HAVING min((value - ({LO_S} + j * 3600)) / 86400) < -19740",
    rules.expiring(VALUE, ["type"], -19740),
    "type",
)
rule(
    "x17_unless_maintenance",
    f"WITH {UPS}, {MS} SELECT instance, site, {T}, value FROM i WHERE value = 0 AND (site, j) NOT IN ({MAINT_ON})",
    lambda ev: X.unless_maintenance(compare(ev.at(UP_SEL), "==", 0), ev.at(MAINT_SEL), ["site"]),
    "instance",
    "site",
)
rule(
    "rule_suppressed",
    f"WITH {UPS}, {MS} SELECT instance, site, {T}, value FROM i WHERE value = 1 AND (site, j) NOT IN ({MAINT_ON}) AND (site, j) NOT IN (SELECT site, j FROM i WHERE value = 0)",
    rules.suppressed(
        rules.gauge(UP_SEL, "==", 1),
        (["site"], rules.gauge(MAINT_SEL, "==", 1)),
        (["site"], rules.gauge(UP_SEL, "==", 0)),
    ),
    "instance",
    "site",
)
rule(
    "rule_counted",
    f"WITH {UPS}, {MS} SELECT site, {T}, CAST(count(*) AS DOUBLE) AS value FROM i WHERE value = 0 AND (site, j) NOT IN ({MAINT_ON}) GROUP BY site, j HAVING count(*) > 0",
    rules.counted(
        rules.suppressed(rules.gauge(UP_SEL, "==", 0), (["site"], rules.gauge(MAINT_SEL, "==", 1))), ["site"], ">", 0
    ),
    "site",
)
rule(
    "rule_summed_over_time",
    f"WITH {UP}, {windowed(DAY)} SELECT instance, site, {T}, sum(value) AS value FROM w GROUP BY instance, site, j HAVING sum(value) > 15",
    rules.summed_over_time(UP_SEL, "1d", ">", 15),
    "instance",
    "site",
)
rule(
    "rule_share_of_gauges",
    f"WITH {GI} SELECT {T}, round(sum(value) FILTER (type = 'error') / sum(value), 6) AS value FROM i GROUP BY j"
    " HAVING sum(value) FILTER (type = 'error') / sum(value) > 0.4",
    rules.share(sel("event_value", eq("type", "error")), VALUE, ">", 0.4),
)
rule(
    "rule_share_of_rates_or_missing",
    f"WITH {CX}, {GRID}, k AS (SELECT j, sum(value) FILTER (type <> 'error') / sum(value) AS r FROM x GROUP BY j), i AS (SELECT DISTINCT j FROM (SELECT unnest(generate_series(greatest(0, CAST(ceil((us - {LO}) / {HOUR}) AS BIGINT)), least({N}, CAST(floor((us + {HOUR} - {LO}) / {HOUR}) AS BIGINT)))) AS j FROM s))"
    f" SELECT {T}, round(r, 6) AS value FROM k WHERE r > 0.801 UNION ALL SELECT {T}, 1.0 FROM g WHERE j NOT IN (SELECT j FROM i) AND j NOT IN (SELECT j FROM k WHERE r > 0.801)",
    rules.share(sel("busy_seconds_total", ne("type", "error")), BUSY, ">", 0.801, d="6h", or_missing=True),
)
rule(
    "rule_missing_for",
    f"WITH {GAUGE}, {windowed(2 * HOUR)}, {GRID} SELECT 'view' AS type, {T}, 1.0::DOUBLE AS value FROM g WHERE j NOT IN (SELECT j FROM w WHERE type = 'view' AND usr <> '1')",
    rules.missing_for(sel("event_value", eq("type", "view"), ne("usr", "1")), "2h"),
    "type",
)
#: Seconds since midnight; the counter of views stands still on two days of three.
STOPPED = (
    "s AS (SELECT event_type AS type, epoch_us(ts) AS us, CASE WHEN event_type = 'view' AND (epoch_us(ts) // 86400000000) % 3 <> 0"
    " THEN 86400.0::DOUBLE ELSE CAST(epoch_us(ts) % 86400000000 AS DOUBLE) / 1e6 END AS value FROM events)"
)


def _standing(t):
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    still = (F.col("labels")["type"] == "view") & (day % 3 != 0)
    v = t.counter.withColumn("value", F.when(still, 86400.0).otherwise(F.col("value")))
    return Evaluator(v, HOURLY, lookback="1h")


@query(
    "rule_files_stopped",
    f"WITH {STOPPED}, {counter_cte('type', DAY)}, now_ AS (SELECT type, j, sum(value) AS v FROM x GROUP BY type, j),"
    f" early AS (WITH {counter_cte('type', DAY, off=DAY)} SELECT type, j, sum(value) AS v FROM x GROUP BY type, j),"
    f" {windowed(HOUR, name='lw')}, n AS (SELECT DISTINCT j FROM lw), {GRID}"
    f" SELECT type, {T} FROM now_ JOIN early USING (type, j) WHERE now_.v = 0 AND early.v > 0"
    f" UNION ALL SELECT '' AS type, {T} FROM g WHERE j NOT IN (SELECT j FROM n)",
)
def _(t):
    found = rules.files_stopped(BUSY, ["type"], "1d", BUSY)(_standing(t))
    return found.select(label("type").alias("type"), seconds("ts").alias("t"))


rule(
    "rule_counts_differ",
    f"WITH {GI}, y AS (SELECT type, j, sum(value) AS v FROM i GROUP BY type, j), {COUNTER.replace('s AS', 'o AS')},"
    f" {windowed(HOUR, off=14 * HOUR, src='o', name='ow')}, oi AS (SELECT type, j, arg_max(value, us) AS v FROM ow GROUP BY type, j)"
    f" SELECT type, {T}, round(abs(y.v - oi.v), 6) AS value FROM y JOIN oi USING (type, j) WHERE abs(y.v - oi.v) > 30000",
    rules.counts_differ(VALUE, ["type"], BUSY, ["usr"], "14h", 30000),
    "type",
)
RATIO = f"{GI}, r AS (SELECT a.usr, a.j, a.value / b.value AS r FROM i a JOIN i b ON a.usr = b.usr AND a.j = b.j AND a.type = 'view' AND b.type = 'click')"


def _pair(t):
    """Two report gauges per user: ``views`` and ``clicks``."""
    v = t.gauge.filter(F.col("labels")["type"].isin("view", "click"))
    metric = F.concat(F.col("labels")["type"], F.lit("s"))
    named = v.withColumn("_m", metric).withColumn("labels", F.map_filter("labels", lambda k, _: k == "usr"))
    return Evaluator(vector(named, F.col("_m")), HOURLY, lookback="1h")


VIEWS, CLICKS = sel("views"), sel("clicks")


@query(
    "rule_report_ratio",
    f"WITH {RATIO}, {GRID} SELECT usr, {T}, round(r, 6) AS value FROM r WHERE r < 0.9 UNION ALL SELECT '', {T}, 1.0 FROM g WHERE j NOT IN (SELECT j FROM r)",
)
def _(t):
    return out(rules.report_ratio(VIEWS, CLICKS, "<", 0.9, "ratio")(_pair(t)), "usr")


@query(
    "rule_earlier_than",
    f"WITH {GI} SELECT a.usr, CAST({LO_S} + a.j * 3600 AS BIGINT) AS t, round(a.value, 6) AS value FROM i a JOIN i b ON a.usr = b.usr AND a.j = b.j AND a.type = 'view' AND b.type = 'click' WHERE a.value < b.value",
)
def _(t):
    return out(rules.earlier_than(VIEWS, CLICKS)(_pair(t)), "usr")


@query(
    "rule_share_left",
    f"WITH {RATIO} SELECT usr, {T}, round(r, 6) AS value FROM r WHERE r < 0.5",
)
def _(t):
    return out(rules.share_left(VIEWS, CLICKS, 0.5)(_pair(t)), "usr")


@query(
    "rule_above_average",
    f"WITH {GI} SELECT a.usr, CAST({LO_S} + a.j * 3600 AS BIGINT) AS t, round(a.value, 6) AS value FROM i a JOIN i b ON a.usr = b.usr AND a.j = b.j AND a.type = 'view' AND b.type = 'click' WHERE a.value > b.value * 1.5",
)
def _(t):
    return out(rules.above_average([VIEWS], CLICKS, 1.5)(_pair(t)), "usr")


rule(
    "rule_grown_by",
    f"WITH {CX} SELECT type, {T}, round(sum(value), 4) AS value FROM x GROUP BY type, j HAVING sum(value) > 21600",
    rules.grown(BUSY, "6h", ">", 21600, by=["type"]),
    "type",
    digits=4,
)
rule(
    "rule_last_rate",
    f"WITH {COUNTER}, {windowed(6 * HOUR)}, r AS (SELECT *, row_number() OVER (PARTITION BY type, j ORDER BY us DESC) AS rn FROM w),"
    " k AS (SELECT type, j, max(us) FILTER (rn = 1) AS u1, max(us) FILTER (rn = 2) AS u0, max(value) FILTER (rn = 1) AS v1, max(value) FILTER (rn = 2) AS v0 FROM r WHERE rn <= 2 GROUP BY type, j),"
    " q AS (SELECT *, (v1 - CASE WHEN v1 < v0 THEN 0 ELSE v0 END) / ((u1 - u0) / 1e6) AS v FROM k WHERE u0 IS NOT NULL)"
    f" SELECT type, {T}, round(v, 6) AS value FROM q WHERE v < 0.9",
    rules.last_rate(BUSY, "6h", "<", 0.9),
    "type",
)
rule(
    "rule_total",
    f"WITH {GI} SELECT {T}, round(sum(value) / 210, 6) AS value FROM i GROUP BY j HAVING sum(value) / 210 > 2",
    rules.total(VALUE, 210, ">", 2),
)
rule(
    "rule_relabelled",
    f"WITH {UPS} SELECT instance, 'rack' || site AS rack, {T}, value FROM i WHERE value = 0",
    rules.relabelled(rules.gauge(UP_SEL, "==", 0), "rack", "rack$1", "site", "(.*)"),
    "instance",
    "rack",
)
def _with_hourly_rows(t):
    """The counters next to one gauge without labels: rows of each hour."""
    hourly = t.ev.groupBy(F.date_trunc("HOUR", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    rows = samples_from(hourly, "stored_rows", {}, "ts", F.col("n"))
    return Evaluator(t.counter.unionByName(rows), HOURLY, lookback="1h")


@query(
    "rule_rows_per_count",
    f"WITH {COUNTER}, {counter_cte('type', DAY, off=4 * HOUR)}, tot AS (SELECT j, sum(value) AS v FROM x GROUP BY j),"
    " h AS (SELECT epoch_us(date_trunc('hour', ts)) AS us, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1),"
    f" {windowed(HOUR, src='h', name='hw')}, one AS (SELECT j, arg_max(value, us) AS v FROM hw GROUP BY j)"
    f" SELECT {T}, round(one.v / tot.v, 9) AS value FROM tot JOIN one USING (j) WHERE one.v / tot.v < 0.00004",
)
def _(t):
    expr = rules.rows_per_count(sel("stored_rows"), BUSY, "1d", "4h", 0.00004)
    return out(expr(_with_hourly_rows(t)), digits=9)


rule(
    "rule_volume_low",
    f"WITH {instant_cte(COUNTER, 'type')}, d AS (SELECT type, j + k AS j, value FROM i, (SELECT unnest([24, 72, 120, 168]) AS k)),"
    " q AS (SELECT type, j, quantile_cont(value, 0.5) AS m FROM d GROUP BY type, j)"
    f" SELECT type, {T}, round(value, 6) AS value FROM i JOIN q USING (type, j) WHERE value < 0.97 * m",
    rules.volume_low(BUSY, {"1d": "1d", "3d": "3d", "5d": "5d", "7d": "1w"}, ["type"], 0.97),
    "type",
)
rule(
    "rule_fleet_unavailable",
    f"WITH {UPS}, {MS}, sig AS (SELECT site, j, value FROM i UNION ALL SELECT site, j, CASE WHEN value <> 1 THEN 1.0 ELSE 0.0 END FROM mi),"
    " worst AS (SELECT site, j, min(value) AS value FROM sig GROUP BY site, j), ok AS (SELECT j, sum(value) AS ok FROM worst GROUP BY j),"
    " den AS (SELECT j, count(*) AS n FROM i WHERE (site, j) NOT IN (SELECT site, j FROM mi WHERE value = 1 AND (site, j) NOT IN (SELECT site, j FROM i)) GROUP BY j)"
    f" SELECT {T}, round(ok / n, 6) AS value FROM ok JOIN den USING (j) WHERE ok / n < 0.9",
    rules.fleet_unavailable(
        probe=UP_SEL,
        group="experiment",
        value="",
        size=None,
        free=None,
        disk_limit=0.95,
        excluded=[],
        own_flags=[],
        maintenance=MAINT_SEL,
        known=UP_SEL,
        member="site",
        below=0.9,
    ),
)
def _site_flag(name: str, value: str) -> str:
    """A gauge per site as CTEs ``<name>w`` and ``<name>i``."""
    return (
        f"{name} AS (SELECT CAST(user_id % 10 AS VARCHAR) AS site, epoch_us(ts) AS us, {value} AS value FROM events),"
        f" {windowed(HOUR, src=name, name=name + 'w')}, {latest('site', name + 'w', name + 'i')}"
    )


def _is(event: str) -> str:
    return f"CASE WHEN event_type = '{event}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(
    "rule_fleet_all_signals",
    f"WITH {UPS}, {MS}, {_site_flag('disk', 'value % 60')}, {_site_flag('drained', _is('purchase'))}, {_site_flag('vetoed', _is('error'))},"
    " sig AS (SELECT site, j, value FROM i UNION ALL SELECT site, j, CASE WHEN value <> 1 THEN 1.0 ELSE 0.0 END FROM mi"
    " UNION ALL SELECT site, j, CASE WHEN (60 - value) / 60 < 0.8 THEN 1.0 ELSE 0.0 END FROM diski"
    " UNION ALL SELECT site, j, CASE WHEN value <> 1 THEN 1.0 ELSE 0.0 END FROM drainedi"
    " UNION ALL SELECT site, j, CASE WHEN value <> 1 THEN 1.0 ELSE 0.0 END FROM vetoedi),"
    " worst AS (SELECT site, j, min(value) AS value FROM sig GROUP BY site, j), ok AS (SELECT j, sum(value) AS ok FROM worst GROUP BY j),"
    " den AS (SELECT j, count(*) AS n FROM i WHERE (site, j) NOT IN (SELECT site, j FROM mi WHERE value = 1 AND (site, j) NOT IN (SELECT site, j FROM i)) GROUP BY j)"
    f" SELECT {T}, round(ok / n, 6) AS value FROM ok JOIN den USING (j) WHERE ok / n < 0.5",
)
def _(t):
    """Probe, disk, exclusion flag and the fleet's own flag together; each has a label of its own,
    since of equal series ``or`` keeps the first."""

    def gauge(name, value):
        labels = {"site": F.col("user_id") % 10, "kind": F.lit(name.partition("_")[0])}
        return samples_from(t.ev, name, labels, "ts", value)

    def flag(event):
        return F.when(F.col("event_type") == event, 1.0).otherwise(0.0)

    parts = [gauge("disk_size", F.lit(60.0)), gauge("disk_free", F.col("value") % 60)]
    parts += [gauge("drained", flag("purchase")), gauge("vetoed", flag("error")), t.maint]
    samples = t.up
    for part in parts:
        samples = samples.unionByName(part)
    expr = rules.fleet_unavailable(
        probe=UP_SEL, group="experiment", value="", size=sel("disk_size"), free=sel("disk_free"), disk_limit=0.8,
        excluded=[sel("drained")], own_flags=[sel("vetoed")], maintenance=MAINT_SEL, known=UP_SEL, member="site", below=0.5,
    )
    return out(expr(Evaluator(samples, HOURLY, lookback="1h")))


rule(
    "rule_any_expr",
    f"WITH {UPS} SELECT instance, site, {T}, value FROM i",
    rules.any_expr(rules.gauge(UP_SEL, "==", 0), rules.gauge(UP_SEL, "==", 1), rules.plain(UP_SEL)),
    "instance",
    "site",
)
@query(
    "s12_recorded_rows",
    f"WITH {CX} SELECT 'type:busy:increase6h' AS metric, '{{\"type\":\"' || type || '\"}}' AS series_id, {T},"
    f" CAST(make_timestamp({LO} + j * {HOUR}) AS DATE)::VARCHAR AS date, 'type:busy:increase6h' AS record, round(sum(value), 4) AS value FROM x GROUP BY type, j",
)
def _(t):
    """Rows as the recorded sink lays them out."""
    v = agg(R.increase(t.counter, "6h", HOURLY), "sum", ["type"])
    rows = recorded_rows(v, "type:busy:increase6h")
    return rows.select("metric", "series_id", seconds("ts").alias("t"), F.col("date").cast("string").alias("date"), "record", F.round("value", 4).alias("value"))


rule(
    "rule_recorded_increase",
    f"WITH {CX} SELECT type, {T}, round(sum(value), 4) AS value FROM x GROUP BY type, j",
    rules.recorded_increase(BUSY, "6h", ["type"]),
    "type",
    digits=4,
)


@query(
    "rule_slow_share",
    "WITH b AS (SELECT DISTINCT epoch_us(ts) AS us, CAST(epoch_us(ts) % 86400000000 AS DOUBLE) / 1e6 AS sec, epoch_us(ts) // 86400000000 AS day FROM events),"
    " s AS (SELECT '+Inf' AS le, us, sec AS value FROM b UNION ALL SELECT '20', us, sec * (0.5 + 0.1 * (day % 3)) FROM b),"
    f" {counter_cte('le', DAY)}, k AS (SELECT a.j, a.value / b.value AS r FROM x a JOIN x b ON a.j = b.j AND a.le = '20' AND b.le = '+Inf')"
    f" SELECT {T}, round(r, 6) AS value FROM k WHERE r < 0.62",
)
def _(t):
    """Buckets as counters that reset at midnight; the share under the bound depends on the day."""
    us = F.unix_micros("ts")
    second, day = F.pmod(us, F.lit(86_400_000_000)) / 1e6, F.floor(us / 86_400_000_000)
    cells = F.array(
        F.struct(F.lit("20").alias("le"), (second * (0.5 + 0.1 * (day % 3))).alias("n")),
        F.struct(F.lit("+Inf").alias("le"), second.alias("n")),
    )
    rows = t.ev.select("ts").distinct().select("ts", F.explode(cells).alias("c")).select("ts", "c.le", "c.n")
    v = samples_from(rows, "latency_bucket", {"le": F.col("le")}, "ts", F.col("n"))
    return out(rules.slow_share(sel("latency_bucket"), "20", "1d", 0.62)(Evaluator(v, HOURLY, lookback="1h")))


#: As ``CX``, beside the gauges: other names for its inputs and steps.
GROWN = re.sub(r"\b([swcapq])( AS \()", r"c\1\2", re.sub(r"FROM ([swcapq])\b", r"FROM c\1", CX))
TEN = [0.5 * k for k in range(1, 9)]


@query(
    "x1_rule_set",
    f"WITH {GI}, {GROWN},"
    f" {MS}, grown AS (SELECT type, j, sum(value) AS v FROM x GROUP BY type, j),"
    f" r AS (SELECT * FROM grown UNION ALL SELECT type, j + 1, v FROM grown a WHERE j < {N} AND NOT EXISTS (SELECT 1 FROM grown b WHERE b.type = a.type AND b.j = a.j + 1))"
    + "".join(
        f"{' UNION ALL' if k else ''} SELECT 'Low{k}' AS alert, type, usr, {T}, round(value, 6) AS value FROM i WHERE value < {10 * limit}"
        for k, limit in enumerate(TEN)
    )
    + f" UNION ALL SELECT 'Maintained', '', site, {T}, value FROM mi WHERE value = 1"
    f" UNION ALL SELECT 'Busy', type, '', {T}, round(v, 3) FROM r WHERE v > 20000",
)
def _(t):
    """Ten alert rules over one scan; the last reads a series that a recording rule makes."""
    samples = t.gauge.unionByName(t.maint).unionByName(t.counter)
    alerts = [AlertRule(f"Low{k}", rules.gauge(VALUE, "<", 10 * limit)) for k, limit in enumerate(TEN)]
    alerts.append(AlertRule("Maintained", rules.gauge(MAINT_SEL, "==", 1)))
    alerts.append(AlertRule("Busy", rules.gauge(sel("type:busy:increase6h"), ">", 20000)))
    recording = [RecordingRule("type:busy:increase6h", rules.recorded_increase(BUSY, "6h", ["type"]))]
    found = eval_rules(alerts, samples, HOURLY, lookback="1h", recording=recording)
    who = F.concat(label("usr"), label("site"))
    digits = F.when(F.col("alert") == "Busy", F.round("value", 3)).otherwise(F.round("value", 6))
    return found.select("alert", label("type").alias("type"), who.alias("usr"), seconds("ts").alias("t"), digits.alias("value"))


# --- lifecycle -----------------------------------------------------------------------

ACTIVE = (
    f"{GAUGE}, {windowed(HOUR)}, act AS (SELECT type, j, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY type, j HAVING count(*) > 2),"
    " r AS (SELECT *, j - row_number() OVER (PARTITION BY type ORDER BY j) AS run FROM act),"
    " st AS (SELECT type, j, value, min(j) OVER (PARTITION BY type, run) AS since FROM r)"
)
BUSY_RULE = AlertRule(
    "TooBusy",
    lambda ev: compare(agg(ev.over_time("count", VALUE, "1h"), "sum", ["type"]), ">", 2),
    hold="2h",
    labels={"severity": "ticket", "team": "{{ $labels.type }}-team"},
    annotations={"summary": "{{ $labels.type }} had {{ $value }} events in {{ $labels.nowhere }}an hour"},
)


def _active(t):
    return eval_rule(BUSY_RULE, evaluator(t))


def _states(t):
    return X.alert_states(_active(t), BUSY_RULE.hold, "1h")


def _firing(t):
    return _states(t).filter(F.col("state") == "firing")


FIRING = f"{ACTIVE}, f AS (SELECT * FROM st WHERE j - since >= 2)"


@query(
    "x1_eval_rule",
    f"WITH {ACTIVE} SELECT 'TooBusy' AS alert, type, {T}, value FROM act",
)
def _(t):
    return _active(t).select("alert", label("type").alias("type"), seconds("ts").alias("t"), "value")


@query(
    "x2_alert_states",
    f"WITH {ACTIVE} SELECT type, {T}, CAST({LO_S} + since * 3600 AS BIGINT) AS since, CASE WHEN j - since >= 2 THEN 'firing' ELSE 'pending' END AS state FROM st",
)
def _(t):
    return _states(t).select(
        label("type").alias("type"), seconds("ts").alias("t"), seconds("since").alias("since"), "state"
    )


INTERVALS = (
    f"{ACTIVE}, iv AS (SELECT type, since, min(j) FILTER (j - since >= 2) AS fired, max(j) + 1 AS resolved FROM st GROUP BY type, since HAVING max(j) - since >= 2)"
)


@query(
    "x4_alert_intervals",
    f"WITH {INTERVALS} SELECT type, CAST({LO_S} + fired * 3600 AS BIGINT) AS fired_at, CASE WHEN resolved <= {N} THEN CAST({LO_S} + resolved * 3600 AS BIGINT) END AS resolved_at FROM iv",
)
def _(t):
    found = X.alert_intervals(_states(t), "1h", end=HOURLY.end / 1e6)
    return found.select(
        label("type").alias("type"), seconds("fired_at").alias("fired_at"), seconds("resolved_at").alias("resolved_at")
    )


@query(
    "x4_resolve_timeout",
    f"WITH {INTERVALS} SELECT type, CAST({LO_S} + (resolved + 2) * 3600 AS BIGINT) AS resolved_at FROM iv",
)
def _(t):
    found = X.alert_intervals(_states(t), "1h", resolve_timeout="3h")
    return found.select(label("type").alias("type"), seconds("resolved_at").alias("resolved_at"))


@query(
    "x5_render",
    f"WITH {ACTIVE} SELECT {T}, type || '-team' AS team, 'ticket' AS severity, type || ' had ' || CAST(value AS VARCHAR) || ' events in an hour' AS summary FROM act",
)
def _(t):
    return _active(t).select(
        seconds("ts").alias("t"),
        label("team").alias("team"),
        label("severity").alias("severity"),
        F.col("annotations")["summary"].alias("summary"),
    )


TREE = X.Route(
    "tickets",
    routes=(
        X.Route("pager", (eq("type", "error"), eq("severity", "ticket")), proceed=True),
        X.Route("audit", (rx("type", "er.*|view"),)),
        X.Route("null", (eq("type", "click"),)),
    ),
)
ROUTED = (
    f"{FIRING}, ro AS (SELECT type, j, unnest(CASE WHEN type = 'error' THEN ['pager', 'audit'] WHEN type = 'view' THEN ['audit']"
    " WHEN type = 'click' THEN ['null'] ELSE ['tickets'] END) AS receiver FROM f)"
)


def _routed(t):
    return X.route(_firing(t), TREE)


@query("x6_route", f"WITH {ROUTED} SELECT type, {T}, receiver FROM ro")
def _(t):
    return _routed(t).select(label("type").alias("type"), seconds("ts").alias("t"), "receiver")


@query("x7_discard", f"WITH {ROUTED} SELECT type, {T}, receiver FROM ro WHERE receiver <> 'null'")
def _(t):
    return X.discard(_routed(t)).select(label("type").alias("type"), seconds("ts").alias("t"), "receiver")


@query(
    "x8_group",
    f"WITH {ROUTED} SELECT {T}, receiver, '{{\"alertname\":\"TooBusy\"}}' AS group_key, count(*) AS alerts FROM ro GROUP BY j, receiver",
)
def _(t):
    grouped = X.group_alerts(_routed(t), ["alertname"])
    counts = grouped.groupBy("ts", "receiver", "group_key").agg(F.count(F.lit(1)).alias("alerts"))
    return counts.select(seconds("ts").alias("t"), "receiver", "group_key", "alerts")


INHIBIT = [
    X.Inhibition((eq("type", "error"),), (rx("type", "view|click"),)),
    X.Inhibition((eq("type", "signup"),), (rx("type", "signup|purchase"),), ("alertname", "nothere")),
]


@query(
    "x10_inhibit",
    f"WITH {FIRING} SELECT type, {T} FROM f WHERE NOT (type IN ('view', 'click') AND j IN (SELECT j FROM f WHERE type = 'error'))"
    " AND NOT (type = 'purchase' AND j IN (SELECT j FROM f WHERE type = 'signup'))",
)
def _(t):
    return X.inhibit(_firing(t), INHIBIT).select(label("type").alias("type"), seconds("ts").alias("t"))


@query(
    "x11_group_summary",
    f"WITH {ROUTED} SELECT {T}, receiver, count(*) AS alerts, CASE WHEN count(*) = 1 THEN '{{\"alertname\":\"TooBusy\",\"severity\":\"ticket\",\"team\":\"' || min(type) || '-team\",\"type\":\"' || min(type) || '\"}}'"
    " ELSE '{\"alertname\":\"TooBusy\",\"severity\":\"ticket\"}' END AS common FROM ro GROUP BY j, receiver",
)
def _(t):
    grouped = X.group_alerts(_routed(t), ["alertname"])
    found = X.summarise_group(grouped, ["ts", "receiver"])
    return found.select(seconds("ts").alias("t"), "receiver", "alerts", "common")


@query(
    "x12_send_resolved",
    f"WITH {INTERVALS}, ro AS (SELECT type, resolved, unnest(CASE WHEN type = 'error' THEN ['pager', 'audit'] WHEN type = 'view' THEN ['audit']"
    f" WHEN type = 'click' THEN ['null'] ELSE ['tickets'] END) AS receiver FROM iv) SELECT type, receiver, resolved <= {N} AS resolved FROM ro WHERE NOT (resolved <= {N} AND receiver = 'audit')",
)
def _(t):
    intervals = X.route(X.alert_intervals(_states(t), "1h", end=HOURLY.end / 1e6), TREE)
    done = F.col("resolved_at").isNotNull()
    kept = X.send_resolved(intervals, {"audit": False, "pager": True}, done)
    return kept.select(label("type").alias("type"), "receiver", done.alias("resolved"))


@query(
    "x13_alert_rollup",
    f"WITH {INTERVALS} SELECT CAST({LO_S} + (fired // 24) * 86400 AS BIGINT) AS time, type, count(*) AS alerts FROM iv GROUP BY 1, 2",
)
def _(t):
    found = X.alert_rollup(X.alert_intervals(_states(t), "1h"), "DAY", ["type"])
    return found.withColumn("time", F.unix_seconds("time"))


@query(
    "x15_lagged_evaluation",
    f"WITH {COUNTER}, {counter_cte('type', DAY, off=14 * HOUR)} SELECT type, {T}, round(sum(value), 4) AS value FROM x GROUP BY type, j",
)
def _(t):
    """Late samples are given time by evaluating a fixed lag behind."""
    return out(agg(R.increase(t.counter, "1d", HOURLY, shift="14h"), "sum", ["type"]), "type", digits=4)
