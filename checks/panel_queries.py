"""Panel frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import (
    COUNTER,
    GAUGE,
    GRID,
    HOUR,
    HOURLY,
    LO_S,
    T,
    UP,
    instant_cte,
    latest,
    out,
    query,
    seconds,
    windowed,
)
from tideline.operators import panels as H
from tideline.operators import rangefn as R

I = instant_cte(GAUGE, "type, usr")


def _inst(t):
    return R.instant(t.gauge, HOURLY, "1h")


def _series(df):
    labels = F.from_json("series_id", "map<string,string>")
    return df.select(labels["type"].alias("type"), labels["usr"].alias("usr"), F.round("value", 6).alias("value"))


@query(
    "h6_median_map",
    "SELECT l_suppkey AS place, quantile_disc(l_extendedprice, 0.5) AS value, count(*) AS value_tests FROM lineitem GROUP BY 1 HAVING count(*) > 590",
)
def _(t):
    df = t.lineitem.select(F.col("l_suppkey").alias("place"), "l_extendedprice")
    return H.median_map(df, "l_extendedprice", ["place"], 590)


@query(
    "h7_point_frame",
    f"WITH {UP}, {windowed(HOUR)}, {latest('instance, site')}, p AS (SELECT CAST(n_nationkey AS VARCHAR) AS site, n_name FROM nation)"
    f" SELECT site, {T}, value, n_name FROM i JOIN p USING (site)",
)
def _(t):
    places = t.nation.select(F.col("n_nationkey").cast("string").alias("site"), "n_name")
    frame = H.point_frame(R.instant(t.up, HOURLY, "1h"), "site", places, "site")
    return frame.select("site", seconds("ts").alias("t"), "value", "n_name")


for _how, _sql in {
    "last": "arg_max(value, j)",
    "mean": "avg(value)",
    "max": "max(value)",
    "min": "min(value)",
    "sum": "sum(value)",
}.items():

    def _make(how):
        return lambda t: _series(H.reduce_series(_inst(t), how))

    query(
        f"h8_reduce_{_how}",
        f"WITH {I} SELECT type, usr, round({_sql}, 6) AS value FROM i GROUP BY type, usr",
    )(_make(_how))


@query("h9_instant_table", f"WITH {I} SELECT type, usr, '' AS zone, {T}, round(value, 6) AS value FROM i")
def _(t):
    frame = H.instant_table(_inst(t), ["type", "usr", "zone"])
    return frame.select("type", "usr", "zone", seconds("ts").alias("t"), F.round("value", 6).alias("value"))


@query("h10_current_table", f"WITH {I} SELECT type, usr, round(arg_max(value, j), 6) AS value FROM i GROUP BY type, usr")
def _(t):
    return _series(H.current_table(_inst(t)))


@query("h11_organize", f"WITH {I} SELECT type AS kind, {T}, round(value, 6) AS current FROM i")
def _(t):
    frame = H.instant_table(_inst(t), ["type", "usr"])
    frame = frame.select("type", "usr", seconds("ts").alias("t"), F.round("value", 6).alias("value"))
    return H.organize(frame, drop=["usr"], rename={"type": "kind", "value": "current"})


@query(
    "h12_hide_all_zero",
    "WITH s AS (SELECT CAST(user_id AS VARCHAR) AS usr, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE WHEN event_type = 'error' AND value > 40 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM events)"
    " SELECT * FROM s WHERE usr IN (SELECT usr FROM s WHERE value <> 0)",
)
def _(t):
    from tideline.sources.samples import samples_from

    big = F.when((F.col("event_type") == "error") & (F.col("value") > 40), 1.0).otherwise(0.0)
    v = samples_from(t.ev, "big_errors", {"usr": F.col("user_id")}, "ts", big)
    return out(H.hide_all(v, "zero"), "usr")


@query(
    "h13_null_as_zero",
    f"WITH {I}, {GRID}, k AS (SELECT DISTINCT type, usr FROM i) SELECT type, usr, {T}, round(coalesce(value, 0), 6) AS value"
    " FROM k CROSS JOIN g LEFT JOIN i USING (type, usr, j)",
)
def _(t):
    return out(H.null_as_zero(_inst(t), HOURLY), "type", "usr")


@query("h14_series_total", f"WITH {I} SELECT type, round(sum(value), 4) AS value FROM i GROUP BY type")
def _(t):
    return H.series_total(_inst(t), ["type"]).select("type", F.round("value", 4).alias("value"))


@query("h15_legend", f"WITH {I} SELECT type || ' of ' || usr AS legend, {T}, round(value, 6) AS value FROM i")
def _(t):
    frame = H.legend(_inst(t), "{{type}} of {{ usr }}")
    return frame.select("legend", seconds("ts").alias("t"), F.round("value", 6).alias("value"))


@query(
    "h16_compare_periods",
    f"WITH {COUNTER}, {windowed(6 * HOUR)}, x AS (SELECT type, j, max(value) AS value FROM w GROUP BY type, j)"
    f" SELECT type, period, CAST({LO_S} + (j + k) * 3600 AS BIGINT) AS t, round(value, 6) AS value FROM x, (VALUES (0, 'now'), (168, 'week')) p(k, period)"
    f" WHERE j + k <= {HOURLY.last}",
)
def _(t):
    def fn(shift):
        return R.over_time(t.counter, "max", "6h", HOURLY, shift)

    frame = H.compare_offsets(fn, {"now": 0, "week": "7d"})
    # the shifted windows also see samples after the grid's first instants
    return frame.select(
        F.col("labels")["type"].alias("type"), "period", seconds("ts").alias("t"), F.round("value", 6).alias("value")
    )


@query(
    "h17_mirror",
    f"WITH {I} SELECT type, usr, {T}, round(value, 6) AS value, 'out' AS direction FROM i UNION ALL SELECT type, usr, {T}, round(-value, 6), 'in' FROM i",
)
def _(t):
    v = _inst(t)
    frame = H.mirror(v, v)
    return frame.select(
        F.col("labels")["type"].alias("type"),
        F.col("labels")["usr"].alias("usr"),
        seconds("ts").alias("t"),
        F.round("value", 6).alias("value"),
        "direction",
    )
