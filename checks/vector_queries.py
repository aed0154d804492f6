"""Selection, vector set operators, aggregation and histograms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.registry import (
    BUCKETS,
    COUNTER,
    GAUGE,
    GRID,
    HOUR,
    HOURLY,
    MAINT,
    T,
    UP,
    counter_cte,
    instant_cte,
    latest,
    out,
    query,
    seconds,
    special_text,
    windowed,
)
from tideline.model import Grid, label, rekey
from tideline.operators import aggregate as G
from tideline.operators import histogram as H
from tideline.operators import rangefn as R
from tideline.operators import select as P
from tideline.operators import vector as A
from tideline.operators.matching import binop, or_default, v_and, v_or, v_or_all, v_unless
from tideline.plans.evaluate import eval_shared
from tideline.sources.samples import federate, retain

DAY = 24 * HOUR
EV_T = "CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t"


def _selection(name: str, where: str):
    return query(
        name,
        "SELECT event_type AS type, CAST(user_id AS VARCHAR) AS usr, CAST(floor(epoch(ts)) AS BIGINT) AS t,"
        f" round(value, 6) AS value FROM (SELECT *, event_type AS type, CAST(user_id AS VARCHAR) AS usr FROM events) WHERE {where}",
    )


def _pick(t, *matchers, metric="event_value"):
    return out(P.select(t.gauge, metric, *matchers), "type", "usr")


@_selection("p1_metric_name", "true")
def _(t):
    return _pick(t)


@_selection("p2_label_equals", "type = 'view'")
def _(t):
    return _pick(t, P.eq("type", "view"), P.eq("nothere", ""))


@_selection("p3_label_not_equals", "type <> 'view'")
def _(t):
    return _pick(t, P.ne("type", "view"), P.ne("usr", ""))


@_selection("p4_regex_anchored", "regexp_full_match(usr, '1.') OR regexp_full_match(usr, '2')")
def _(t):
    return _pick(t, P.rx("usr", "1.|2"))


@_selection("p5_negative_regex", "NOT regexp_full_match(type, 'view|cl.*')")
def _(t):
    return _pick(t, P.nrx("type", "view|cl.*"))


@_selection("p6_several_matchers", "regexp_full_match(usr, '1.*') AND usr <> '10' AND type <> 'error'")
def _(t):
    return _pick(t, P.rx("usr", "1.*"), P.ne("usr", "10"), P.ne("type", "error"))


@_selection("p7_variable_regex", "type IN ('view', 'error')")
def _(t):
    return _pick(t, P.rx("type", P.var_regex(["view", "error"])), P.rx("usr", P.var_regex(None)))


@query(
    "s1_samples",
    "SELECT 'event_value' AS metric, '{\"type\":\"' || event_type || '\",\"usr\":\"' || user_id || '\"}' AS series_id,"
    " epoch_us(ts) AS us, value FROM events",
)
def _(t):
    return t.gauge.select("metric", "series_id", F.unix_micros("ts").alias("us"), "value")


@query(
    "s11_federate",
    "SELECT event_type AS type, CAST(user_id AS VARCHAR) AS usr, 'inner' AS cluster,"
    " CAST(floor(epoch(ts)) AS BIGINT) AS t, round(value, 6) AS value FROM events"
    " WHERE event_type = 'error' OR regexp_full_match(CAST(user_id AS VARCHAR), '.*7')",
)
def _(t):
    wanted = [P.sel("event_value", P.eq("type", "error")), P.sel("event_value", P.rx("usr", ".*7"))]
    return out(federate(t.gauge, wanted, {"cluster": "inner"}), "type", "usr", "cluster")


@query(
    "s14_retention",
    "SELECT event_type AS type, CAST(user_id AS VARCHAR) AS usr, CAST(floor(epoch(ts)) AS BIGINT) AS t,"
    " round(value, 6) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-18'",
)
def _(t):
    return out(retain(t.gauge, 10, datetime(2024, 1, 28).date()), "type", "usr")


# --- set operators -------------------------------------------------------------------

UPS = f"{UP}, {windowed(HOUR)}, {latest('instance, site')}"
MS = f"{MAINT}, {windowed(HOUR, src='m', name='mw')}, {latest('site', 'mw', 'mi')}"


def _up(t):
    return R.instant(t.up, HOURLY, "1h")


def _maint(t):
    return R.instant(t.maint, HOURLY, "1h")


def _ups(name, tail):
    return query(name, f"WITH {UPS}, {MS} SELECT instance, site, {T}, value FROM i {tail}")


@_ups("j1_and", "WHERE value = 0 AND (instance, site, j) IN (SELECT instance, site, j FROM w GROUP BY ALL HAVING count(*) > 2)")
def _(t):
    many = A.compare(R.over_time(t.up, "count", "1h", HOURLY), ">", 2)
    return out(v_and(A.compare(_up(t), "==", 0), many), "instance", "site")


@_ups("j2_and_on", "WHERE (site, j) IN (SELECT site, j FROM mi WHERE value = 1)")
def _(t):
    return out(v_and(_up(t), A.compare(_maint(t), "==", 1), on=["site"]), "instance", "site")


@query(
    "j3_or",
    f"WITH {UPS}, z AS (SELECT instance, site, j, CAST(count(*) AS DOUBLE) AS value FROM w GROUP BY ALL),"
    " a AS (SELECT * FROM i WHERE value = 0)"
    f" SELECT instance, site, {T}, value FROM a UNION ALL SELECT instance, site, {T}, value FROM z"
    " WHERE (instance, site, j) NOT IN (SELECT instance, site, j FROM a)",
)
def _(t):
    counts = R.over_time(t.up, "count", "1h", HOURLY)
    return out(v_or(A.compare(_up(t), "==", 0), counts), "instance", "site")


@_ups("j5_unless_on", "WHERE value = 0 AND (site, j) NOT IN (SELECT site, j FROM mi WHERE value = 1)")
def _(t):
    return out(
        v_unless(A.compare(_up(t), "==", 0), A.compare(_maint(t), "==", 1), on=["site"]),
        "instance",
        "site",
    )


@_ups(
    "j6_unless_chain",
    "WHERE (site, j) NOT IN (SELECT site, j FROM mi WHERE value = 1)"
    " AND (instance, j) NOT IN (SELECT instance, j FROM w GROUP BY ALL HAVING count(*) > 2)",
)
def _(t):
    many = A.compare(G.agg(R.over_time(t.up, "count", "1h", HOURLY), "sum", ["instance"]), ">", 2)
    first = v_unless(_up(t), A.compare(_maint(t), "==", 1), on=["site"])
    return out(v_unless(first, many, on=["instance"]), "instance", "site")


@query(
    "j7_or_default",
    f"WITH {UPS}, {GRID}, z AS (SELECT j, sum(value) AS value FROM i WHERE value = 0 GROUP BY j)"
    f" SELECT {T}, coalesce(value, 7.0) AS value FROM g LEFT JOIN z USING (j)",
)
def _(t):
    return out(or_default(G.agg(A.compare(_up(t), "==", 0), "sum"), 7.0, HOURLY))


@_ups(
    "j8_nested_unless",
    "WHERE (site, j) NOT IN (SELECT site, j FROM mi WHERE value = 1 AND (site, j) NOT IN"
    " (SELECT site, j FROM i WHERE value = 0))",
)
def _(t):
    excused = v_unless(A.compare(_maint(t), "==", 1), A.compare(_up(t), "==", 0), on=["site"])
    return out(v_unless(_up(t), excused, on=["site"]), "instance", "site")


@query(
    "u4_vector_sets",
    f"WITH {UPS}, n AS (SELECT instance, site, j, CAST(count(*) AS DOUBLE) AS c FROM w GROUP BY ALL)"
    f" SELECT instance, site, {T}, CASE WHEN value = 0 THEN value WHEN c > 2 THEN c ELSE 50.0 + value END AS value"
    " FROM i JOIN n USING (instance, site, j)",
)
def _(t):
    counts = R.over_time(t.up, "count", "1h", HOURLY)
    parts = [A.compare(_up(t), "==", 0), A.compare(counts, ">", 2), A.arith(_up(t), "+", 50)]
    return out(v_or_all(*parts), "instance", "site")


# --- aggregation ---------------------------------------------------------------------

I = instant_cte(GAUGE, "type, usr", 6 * HOUR)


def _inst(t):
    return R.instant(t.gauge, HOURLY, "6h")


@query("g1_sum", f"WITH {I} SELECT {T}, round(sum(value), 4) AS value FROM i GROUP BY j")
def _(t):
    return out(G.agg(_inst(t), "sum"), digits=4)


def _by(name, sql, how, q=None, digits=6):
    def run(t):
        return out(G.agg(_inst(t), how, ["type"], q), "type", digits=digits)

    query(name, f"WITH {I} SELECT type, {T}, round(CAST({sql} AS DOUBLE), {digits}) AS value FROM i GROUP BY type, j")(run)


_by("g2_sum_by", "sum(value)", "sum", digits=4)
_by("g3_count_by", "count(*)", "count")
_by("g4_avg_by", "avg(value)", "avg", digits=9)
_by("g5_min_by", "min(value)", "min")
_by("g6_max_by", "max(value)", "max")
_by("g7_quantile_by", "quantile_cont(value, 0.95)", "quantile", 0.95, digits=4)


@query("g3_count", f"WITH {I} SELECT {T}, CAST(count(*) AS DOUBLE) AS value FROM i GROUP BY j")
def _(t):
    return out(G.agg(_inst(t), "count"))


@query("g7_quantile", f"WITH {I} SELECT {T}, round(quantile_cont(value, 0.5), 4) AS value FROM i GROUP BY j")
def _(t):
    return out(G.agg(_inst(t), "quantile", q=0.5), digits=4)


TOP = (
    f"WITH {I} SELECT type, usr, {T}, round(value, 6) AS value FROM i QUALIFY"
    " row_number() OVER (PARTITION BY j ORDER BY value DESC, '{\"type\":\"' || type || '\",\"usr\":\"' || usr || '\"}') <= 3"
)


@query("g8_topk", TOP)
def _(t):
    return out(G.topk(_inst(t), 3), "type", "usr")


@query(
    "t4_grouped_topk",
    TOP.replace("PARTITION BY j", "PARTITION BY j, type"),
)
def _(t):
    return out(G.topk(_inst(t), 3, ["type"]), "type", "usr")


def _histogram_sql(q: float, digits: int = 4) -> str:
    return (
        f"WITH {BUCKETS}, c AS (SELECT flag, t, bound, value AS cum, lag(bound) OVER o AS pb, lag(value) OVER o AS pc,"
        " max(value) OVER (PARTITION BY flag, t) AS total FROM b WINDOW o AS (PARTITION BY flag, t ORDER BY bound)),"
        f" h AS (SELECT *, {q} * total AS rank FROM c)"
        f" SELECT flag, t, round(CASE WHEN bound = 'Infinity'::DOUBLE THEN pb ELSE coalesce(pb, 0) + (bound - coalesce(pb, 0))"
        f" * (rank - coalesce(pc, 0)) / (cum - coalesce(pc, 0)) END, {digits}) AS value FROM h"
        " WHERE cum >= rank AND (pc IS NULL OR pc < rank)"
    )


@query("g9_histogram_quantile", _histogram_sql(0.9))
def _(t):
    return out(H.histogram_quantile(t.buckets, 0.9), "flag", digits=4)


@query("g9_histogram_odd_bounds", _histogram_sql(0.9))
def _(t):
    """Series without a number in ``le`` are no buckets, and a bound may be written in two ways."""
    other = F.when(F.col("labels")["le"] == "25000", "2.5e4").when(F.col("labels")["le"] == "50000", "none")
    half = t.buckets.withColumn("value", F.col("value") / 2)
    odd = half.filter(F.col("labels")["le"] == "25000")
    rest = t.buckets.filter(F.col("labels")["le"] != "25000")
    written = half.filter(F.col("labels")["le"].isin("25000", "50000"))
    renamed = F.map_concat(F.map_filter("labels", lambda k, _: k != "le"), F.create_map(F.lit("le"), other))
    v = rest.unionByName(odd).unionByName(rekey(written.withColumn("labels", renamed)))
    return out(H.histogram_quantile(v, 0.9), "flag", digits=4)


@query("g9_histogram_median", _histogram_sql(0.5))
def _(t):
    return out(H.histogram_quantile(t.buckets, 0.5), "flag", digits=4)


@query(
    "g9_histogram_of_increase",
    "WITH s AS (SELECT flag, le, bound, t * 1000000 AS us, value FROM (" + "WITH " + BUCKETS + " SELECT * FROM b)),"
    " d AS (SELECT flag, le, bound, us, sum(value) OVER (PARTITION BY flag, le ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS value FROM s),"
    " e AS (SELECT flag, bound, us, value AS cum, lag(bound) OVER o AS pb, lag(value) OVER o AS pc, max(value) OVER (PARTITION BY flag, us) AS total"
    " FROM d WINDOW o AS (PARTITION BY flag, us ORDER BY bound)), h AS (SELECT *, 0.9 * total AS rank FROM e)"
    " SELECT flag, CAST(us // 1000000 AS BIGINT) AS t, round(CASE WHEN bound = 'Infinity'::DOUBLE THEN pb ELSE coalesce(pb, 0)"
    " + (bound - coalesce(pb, 0)) * (rank - coalesce(pc, 0)) / (cum - coalesce(pc, 0)) END, 4) AS value FROM h"
    " WHERE cum >= rank AND (pc IS NULL OR pc < rank) AND (flag, us) IN (SELECT flag, us FROM s)",
)
def _(t):
    """Quantile of bucket counts summed over a trailing week, at days with shipments."""
    grid = Grid.of(datetime(1995, 1, 1), datetime(2001, 12, 31), "1d")
    weekly = R.over_time(t.buckets, "sum", "7d", grid)
    found = H.histogram_quantile(weekly, 0.9)
    days = G.agg(t.buckets, "count", ["flag"])
    return out(v_and(found, days, on=["flag"]), "flag", digits=4)


@query(
    "g10_histogram_mean",
    "SELECT CAST(epoch(l_shipdate) AS BIGINT) AS t, round(sum(l_extendedprice) / count(*), 7) AS value"
    " FROM lineitem GROUP BY l_shipdate",
)
def _(t):
    from tideline.sources.samples import samples_from

    rows = t.lineitem.groupBy("l_shipdate", "l_returnflag").agg(
        F.sum("l_extendedprice").alias("s"), F.count(F.lit(1)).alias("n")
    )
    flag = {"flag": F.col("l_returnflag")}
    total = samples_from(rows, "price_sum", flag, "l_shipdate", F.col("s"))
    count = samples_from(rows, "price_count", flag, "l_shipdate", F.col("n"))
    return out(binop("/", G.agg(total, "sum"), G.agg(count, "sum")), digits=7)


@query(
    "g11_bucket_share",
    f"WITH {BUCKETS} SELECT t, round(sum(value) FILTER (le = '50000') / sum(value) FILTER (le = '+Inf'), 6) AS value"
    " FROM b GROUP BY t",
)
def _(t):
    grid = Grid.of(datetime(1995, 1, 1), datetime(2001, 12, 31), "1d")
    return out(G.bucket_share(t.buckets, "50000", grid))


@query(
    "g12_ratio_by",
    f"WITH {UPS}, k AS (SELECT site, j, sum(value) AS s, sum(value) FILTER (regexp_full_match(instance, '1.')) AS p"
    f" FROM i GROUP BY site, j) SELECT site, {T}, CASE WHEN s = 0 THEN 'NaN' ELSE CAST(CAST(round(p / s * 1000000) AS BIGINT) AS VARCHAR) END AS value"
    " FROM k WHERE p IS NOT NULL",
)
def _(t):
    found = G.ratio(_up(t), P.rx("instance", "1."), ["site"])
    return found.select(label("site").alias("site"), seconds("ts").alias("t"), special_text(F.col("value"), 1_000_000).alias("value"))


@query(
    "g13_availability",
    f"WITH {UPS}, {MS}, n AS (SELECT instance, site, j, count(*) AS c FROM w GROUP BY ALL),"
    " sig AS (SELECT site, j, CASE WHEN value <> 1 THEN value ELSE value END AS value FROM i"
    " UNION ALL SELECT site, j, CASE WHEN value <> 1 THEN 1.0 ELSE 0.0 END FROM mi),"
    " worst AS (SELECT site, j, min(value) AS value FROM sig GROUP BY site, j),"
    " up_ AS (SELECT j, sum(value) AS ok FROM worst GROUP BY j),"
    " den AS (SELECT j, count(*) AS n FROM i WHERE (site, j) NOT IN (SELECT site, j FROM mi WHERE value = 1"
    " AND (site, j) NOT IN (SELECT site, j FROM i WHERE value = 0)) GROUP BY j)"
    f" SELECT {T}, round(ok / n, 6) AS value FROM up_ JOIN den USING (j)",
)
def _(t):
    """Both gauges are read several times, from one scan and one window job."""

    def expr(ev):
        up, maint = ev.at(P.sel("up")), ev.at(P.sel("maint"))
        flag = A.compare(maint, "!=", 1, as_bool=True)
        excused = v_unless(A.compare(maint, "==", 1), A.compare(up, "==", 0), on=["site"])
        return G.availability([up, flag], up, excused, ["site"])

    return out(eval_shared(expr, t.up.unionByName(t.maint), HOURLY, "1h"))


SEASON = (
    f"{GAUGE}, z AS (SELECT type, us, value FROM s), {windowed(DAY, src='z')},"
    " v AS (SELECT type, j, sum(value) AS value FROM w GROUP BY type, j),"
    " d AS (SELECT type, j + k AS j, value FROM v, (SELECT unnest([24, 72, 120, 168]) AS k)),"
    " q AS (SELECT type, j, quantile_cont(value, 0.5) AS m FROM d GROUP BY type, j)"
)


@query(
    "g14_seasonal_low",
    f"WITH {SEASON} SELECT type, {T}, round(value, 4) AS value FROM v JOIN q USING (type, j) WHERE value < 0.9 * m",
)
def _(t):
    daily = G.agg(R.over_time(G.merged(t.gauge, ["type"]), "sum", "1d", HOURLY), "sum", ["type"])
    earlier = {d: R.offset(daily, d) for d in ("1d", "3d", "5d", "7d")}
    return out(G.seasonal_low(daily, earlier, ["type"], 0.9), "type", digits=4)


# --- bucket frames -------------------------------------------------------------------


@query(
    "h1_heatmap",
    f"WITH {BUCKETS} SELECT flag, t, CASE WHEN bound = 'Infinity'::DOUBLE THEN 'inf' ELSE CAST(CAST(bound AS BIGINT) AS VARCHAR) END AS le,"
    " value - coalesce(lag(value) OVER (PARTITION BY flag, t ORDER BY bound), 0) AS value FROM b",
)
def _(t):
    le = F.when(F.col("le") == float("inf"), "inf").otherwise(
        F.when(F.col("le") == float("inf"), 0.0).otherwise(F.col("le")).cast("bigint").cast("string")
    )
    frame = H.heatmap(t.buckets)
    return frame.select(
        F.from_json("gid", "map<string,string>")["flag"].alias("flag"),
        seconds("ts").alias("t"),
        le.alias("le"),
        "value",
    )


@query(
    "h2_heatmap_avg",
    f"WITH {BUCKETS}, a AS (SELECT t, bound, 100 * avg(value) AS value FROM b GROUP BY t, bound)"
    " SELECT t, CASE WHEN bound = 'Infinity'::DOUBLE THEN -1 ELSE CAST(bound AS BIGINT) END AS le,"
    " round(value - coalesce(lag(value) OVER (PARTITION BY t ORDER BY bound), 0), 4) AS value FROM a",
)
def _(t):
    frame = H.heatmap(A.arith(G.agg(t.buckets, "avg", ["le"]), "*", 100))
    finite = F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).cast("bigint")
    return frame.select(seconds("ts").alias("t"), finite.alias("le"), F.round("value", 4).alias("value"))


@query(
    "entry_recorded_increase",
    f"WITH {COUNTER}, {counter_cte('type', DAY)} SELECT type, {T}, round(sum(value), 4) AS value FROM x GROUP BY type, j",
)
def _(t):
    return out(G.agg(R.increase(t.counter, "24h", HOURLY), "sum", ["type"]), "type", digits=4)
