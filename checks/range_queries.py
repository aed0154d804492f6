"""Grid, range-vector and element-wise operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.registry import (
    COUNTER,
    GAUGE,
    GRID,
    HOUR,
    HOURLY,
    LO,
    LO_S,
    N,
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
from tideline.operators import rangefn as R
from tideline.operators import select as P
from tideline.operators import vector as A
from tideline.operators.aggregate import agg, merged
from tideline.operators.matching import binop
from tideline.shared import expanded

DAY = 24 * HOUR


@query(
    "r1_grid",
    f"WITH {GRID}, e AS (SELECT CAST(ceil((epoch_us(ts) - {LO}) / {HOUR}) AS BIGINT) AS j FROM events)"
    f" SELECT {T}, (SELECT count(*) FROM e WHERE e.j = g.j) AS events FROM g",
)
def _(t):
    """Events that came since the previous evaluation, at every evaluation."""
    tick = F.ceil((F.unix_micros("ts") - F.lit(LO)) / HOUR)
    seen = t.ev.groupBy(F.timestamp_micros(F.lit(LO) + tick * F.lit(HOUR)).alias("ts")).agg(
        F.count(F.lit(1)).alias("n")
    )
    joined = HOURLY.instants(t.spark).join(seen, "ts", "left")
    return joined.select(seconds("ts").alias("t"), F.coalesce("n", F.lit(0)).alias("events"))


@query(
    "r2_instant",
    f"WITH {instant_cte(GAUGE, 'type, usr')} SELECT type, usr, {T}, round(value, 6) AS value FROM i",
)
def _(t):
    return out(R.instant(t.gauge, HOURLY, "1h"), "type", "usr")


@query(
    "r3_rate",
    f"WITH {COUNTER}, {counter_cte('type', 6 * HOUR, step=HOUR // 4)}"
    f" SELECT type, CAST({LO_S} + j * 900 AS BIGINT) AS t, round(value / 21600, 6) AS value FROM x",
)
def _(t):
    grid = Grid(HOURLY.start, HOURLY.end, HOUR // 4)
    return out(R.rate(t.counter, "6h", grid), "type")


@query(
    "r4_increase",
    f"WITH {COUNTER}, {counter_cte('type', DAY)} SELECT type, {T}, round(value, 4) AS value FROM x",
)
def _(t):
    return out(R.increase(t.counter, "1d", HOURLY), "type", digits=4)


@query(
    "r4_increase_raw",
    f"WITH {COUNTER}, {counter_cte('type', DAY)} SELECT type, {T}, round(raw, 4) AS value FROM x",
)
def _(t):
    return out(R.increase(t.counter, "1d", HOURLY, mode="raw"), "type", digits=4)


@query(
    "r4_increase_odd_window",
    f"WITH {GAUGE}, {counter_cte('type, usr', 90 * 60_000_000)}"
    f" SELECT type, usr, {T}, round(value, 4) AS value FROM x",
)
def _(t):
    """Window that is no multiple of the step, on series that reset at random."""
    return out(R.increase(t.gauge, "90m", HOURLY), "type", "usr", digits=4)


@query(
    "r4_increase_short_window",
    f"WITH {COUNTER}, {counter_cte('type', 20 * 60_000_000)} SELECT type, {T}, round(value, 4) AS value FROM x",
)
def _(t):
    """Window shorter than the step: samples between windows are dropped first."""
    return out(R.increase(t.counter, "20m", HOURLY), "type", digits=4)


@query(
    "r5_irate",
    f"WITH {COUNTER}, {windowed(6 * HOUR)},"
    " r AS (SELECT *, row_number() OVER (PARTITION BY type, j ORDER BY us DESC) AS rn FROM w),"
    " k AS (SELECT type, j, max(us) FILTER (rn = 1) AS u1, max(us) FILTER (rn = 2) AS u0,"
    " max(value) FILTER (rn = 1) AS v1, max(value) FILTER (rn = 2) AS v0 FROM r WHERE rn <= 2 GROUP BY type, j)"
    f" SELECT type, {T}, round((v1 - CASE WHEN v1 < v0 THEN 0 ELSE v0 END) / ((u1 - u0) / 1e6), 6) AS value"
    " FROM k WHERE u0 IS NOT NULL",
)
def _(t):
    return out(R.irate(t.counter, "6h", HOURLY), "type")


@query(
    "r6_resets",
    f"WITH {GAUGE}, {windowed(6 * HOUR)},"
    " c AS (SELECT *, lag(value) OVER (PARTITION BY type, usr, j ORDER BY us) AS pv FROM w)"
    f" SELECT type, usr, {T}, CAST(count(*) FILTER (value < pv) AS DOUBLE) AS value FROM c GROUP BY type, usr, j",
)
def _(t):
    return out(R.resets(t.gauge, "6h", HOURLY), "type", "usr")


def _over(how: str, sql: str, d: str = "6h", span: int = 6 * HOUR):
    return (
        f"WITH {GAUGE}, {windowed(span)} SELECT type, usr, {T}, round(CAST({sql} AS DOUBLE), 6) AS value"
        " FROM w GROUP BY type, usr, j"
    )


for _name, _how, _sql, _d, _span in [
    ("r7_sum_over_time", "sum", "sum(value)", "6h", 6 * HOUR),
    ("r7_sum_over_time_day", "sum", "sum(value)", "1d", DAY),
    ("r8_avg_over_time", "avg", "avg(value)", "6h", 6 * HOUR),
    ("r9_count_over_time", "count", "count(*)", "6h", 6 * HOUR),
    ("r11_last_over_time", "last", "arg_max(value, us)", "6h", 6 * HOUR),
]:

    def _make(how, d):
        return lambda t: out(R.over_time(t.gauge, how, d, HOURLY), "type", "usr")

    query(_name, _over(_how, _sql, _d, _span))(_make(_how, _d))


@query(
    "r10_quantile_over_time",
    f"WITH {COUNTER}, {windowed(6 * HOUR)}"
    f" SELECT type, {T}, round(quantile_cont(value, 0.9), 8) AS value FROM w GROUP BY type, j",
)
def _(t):
    return out(R.over_time(t.counter, "quantile", "6h", HOURLY, q=0.9), "type", digits=8)


@query(
    "r10_quantile_over_subquery",
    f"WITH {GAUGE}, {windowed(3 * HOUR)},"
    " inner_ AS (SELECT type, usr, j, avg(value) AS value FROM w GROUP BY type, usr, j),"
    f" again AS (SELECT type, usr, value, unnest(generate_series(j, least({N}, j + 6))) AS k FROM inner_)"
    f" SELECT type, usr, CAST({LO_S} + k * 3600 AS BIGINT) AS t, round(quantile_cont(value, 0.75), 6) AS value"
    " FROM again GROUP BY type, usr, k",
)
def _(t):
    """Over a computed vector, which has no metric name."""
    inner = R.subquery(lambda g: R.over_time(t.gauge, "avg", "3h", g), "6h", "1h", HOURLY)
    return out(R.over_time(inner, "quantile", "6h", HOURLY, q=0.75), "type", "usr")


QUARTER = Grid.of(datetime(2024, 1, 1), datetime(2024, 1, 31), "15m")


@query(
    "r10_quantile_over_day",
    f"WITH {COUNTER}, w AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((us - {QUARTER.start}) / {QUARTER.step}) AS BIGINT)),"
    f" least({QUARTER.last}, CAST(floor((us + {DAY} - {QUARTER.start}) / {QUARTER.step}) AS BIGINT)))) AS j FROM s)"
    f" SELECT type, CAST(({QUARTER.start} + j * {QUARTER.step}) // 1000000 AS BIGINT) AS t, round(quantile_cont(value, 0.9), 8) AS value FROM w GROUP BY type, j",
)
def _(t):
    """A day's window every 15 minutes, whose samples are not repeated for each."""
    return out(R.over_time(t.counter, "quantile", "1d", QUARTER, q=0.9), "type", digits=8)


# the whole table like HOURLY, by steps that divide neither an hour nor a day
ODD = Grid.of(datetime(2024, 1, 1), datetime(2024, 1, 31), "61s")
SEVEN = Grid.of(datetime(2024, 1, 1), datetime(2024, 1, 31), "7m")


def _on(grid: Grid, src: str, d: int) -> str:
    """Samples of ``src`` per evaluation of any grid as CTE ``w``."""
    return (
        f"w AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((us - {grid.start}) / {grid.step}) AS BIGINT)),"
        f" least({grid.last}, CAST(floor((us + {d} - {grid.start}) / {grid.step}) AS BIGINT)))) AS j FROM {src}"
        f" WHERE us BETWEEN {grid.start - d} AND {grid.start + grid.last * grid.step})"
    )


def _tick(grid: Grid) -> str:
    return f"CAST(({grid.start} + j * {grid.step}) // 1000000 AS BIGINT) AS t"


for _name, _grid in (("61s", ODD), ("7m", SEVEN)):
    query(
        f"r15_sum_over_time_step_{_name}",
        f"WITH {GAUGE}, {_on(_grid, 's', DAY)} SELECT type, {_tick(_grid)}, round(sum(value), 4) AS value FROM w GROUP BY type, j",
    )(lambda t, g=_grid: out(agg(R.over_time(merged(t.gauge, ["type"]), "sum", "1d", g), "sum", ["type"]), "type", digits=4))
    query(
        f"r15_increase_step_{_name}",
        f"WITH {COUNTER}, {_on(_grid, 's', DAY)}, c AS (SELECT type, j, us, value, lag(value) OVER (PARTITION BY type, j ORDER BY us) AS pv FROM w)"
        f" SELECT type, {_tick(_grid)}, round(arg_max(value, us) - arg_min(value, us) + sum(CASE WHEN value < pv THEN pv ELSE 0 END), 6) AS value"
        " FROM c GROUP BY type, j HAVING count(*) > 1",
    )(lambda t, g=_grid: out(R.increase(t.counter, "1d", g, mode="raw"), "type"))


@query(
    "r12_predict_linear",
    f"WITH {GAUGE}, {windowed(DAY)},"
    f" f AS (SELECT type, usr, j, count(*) AS n, regr_slope(value, (us - ({LO} + j * {HOUR})) / 1e6) AS a,"
    f" regr_intercept(value, (us - ({LO} + j * {HOUR})) / 1e6) AS b FROM w GROUP BY type, usr, j)"
    f" SELECT type, usr, {T}, CASE WHEN n > 2 THEN round(b + a * 3600, 3) ELSE 0 END AS value,"
    " CASE WHEN n = 2 THEN CASE WHEN b + a * 3600 > 1e4 THEN 'above' WHEN b + a * 3600 < -1e4 THEN 'below' ELSE 'near' END ELSE '' END AS two FROM f WHERE n > 1",
)
def _(t):
    v = R.predict_linear(t.gauge, "1d", 3600.0, HOURLY)
    # two samples can be microseconds apart, which no two summations round alike: there the side is compared
    n = R.over_time(t.gauge, "count", "1d", HOURLY).select("series_id", "ts", F.col("value").alias("n"))
    both = v.join(expanded(n), ["series_id", "ts"])
    side = F.when(F.col("value") > 1e4, "above").when(F.col("value") < -1e4, "below").otherwise("near")
    return both.select(
        label("type").alias("type"), label("usr").alias("usr"), seconds("ts").alias("t"),
        F.when(F.col("n") > 2, F.round("value", 3)).otherwise(0.0).alias("value"),
        F.when(F.col("n") == 2, side).otherwise("").alias("two"),
    )


@query(
    "r13_subquery",
    f"WITH {GAUGE}, {windowed(3 * HOUR)},"
    " inner_ AS (SELECT type, usr, j, avg(value) AS value FROM w GROUP BY type, usr, j),"
    f" again AS (SELECT type, usr, value, unnest(generate_series(j, least({N}, j + 6))) AS k FROM inner_)"
    f" SELECT type, usr, CAST({LO_S} + k * 3600 AS BIGINT) AS t, round(max(value), 6) AS value"
    " FROM again GROUP BY type, usr, k",
)
def _(t):
    inner = R.subquery(lambda g: R.over_time(t.gauge, "avg", "3h", g), "6h", "1h", HOURLY)
    return out(R.over_time(inner, "max", "6h", HOURLY), "type", "usr")


@query(
    "r14_offset_instant",
    f"WITH {instant_cte(GAUGE, 'type, usr', off=DAY)} SELECT type, usr, {T}, round(value, 6) AS value FROM i",
)
def _(t):
    return out(R.instant(R.offset(t.gauge, "1d"), HOURLY, "1h"), "type", "usr")


@query(
    "r14_offset_increase",
    f"WITH {COUNTER}, {counter_cte('type', 6 * HOUR, off=14 * HOUR)}"
    f" SELECT type, {T}, round(value, 4) AS value FROM x",
)
def _(t):
    return out(R.increase(t.counter, "6h", HOURLY, shift="14h"), "type", digits=4)


@query(
    "r15_rate_interval",
    f"WITH {COUNTER}, {counter_cte('type', 2 * HOUR)} SELECT type, {T}, round(value / 7200, 6) AS value FROM x",
)
def _(t):
    window = R.rate_interval("1h", "30m") / 1_000_000
    return out(R.rate(t.counter, window, HOURLY), "type")


@query(
    "f17_unit_conversion",
    f"WITH {COUNTER}, {counter_cte('type', 2 * HOUR)} SELECT type, {T}, round(8 * value / 7200, 6) AS value FROM x",
)
def _(t):
    """Bytes to bits per second."""
    return out(A.rarith(8, "*", R.rate(t.counter, "2h", HOURLY)), "type")


# --- element-wise --------------------------------------------------------------------

I = instant_cte(GAUGE, "type, usr")


def _elementwise(name, expr, where="true"):
    return query(
        name,
        f"WITH {I} SELECT type, usr, {T}, round({expr}, 6) AS value FROM i WHERE {where}",
    )


def _inst(t):
    return R.instant(t.gauge, HOURLY, "1h")


NOW = f"({LO_S} + j * 3600)"


@_elementwise("a1_arith_scalar", "value * 8 / 60")
def _(t):
    return out(A.arith(A.arith(_inst(t), "*", 8), "/", 60), "type", "usr")


@_elementwise("a2_scalar_arith", f"{NOW} - value")
def _(t):
    return out(A.age(_inst(t)), "type", "usr")


@_elementwise("a3_negate", "-value")
def _(t):
    return out(A.neg(_inst(t)), "type", "usr")


@_elementwise("a7_compare_filter", "value", "value > 20")
def _(t):
    return out(A.compare(_inst(t), ">", 20), "type", "usr")


@_elementwise("a9_bool", "CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
def _(t):
    return out(A.compare(_inst(t), "<", 20, as_bool=True), "type", "usr")


@_elementwise("a10_abs", "abs(value - 20)")
def _(t):
    return out(A.vabs(A.arith(_inst(t), "-", 20)), "type", "usr")


@_elementwise("a11_time", f"CAST({NOW} AS DOUBLE)")
def _(t):
    return out(A.map_value(_inst(t), A.eval_seconds()), "type", "usr")


@query(
    "a12_vector",
    f"WITH {I} SELECT {T}, round(999 - sum(value), 4) AS value FROM i GROUP BY j",
)
def _(t):
    total = agg(_inst(t), "sum")
    return out(binop("-", A.constant(HOURLY.instants(t.spark), 999), total), digits=4)


TWO = (
    f"{instant_cte(GAUGE, 'type, usr', 6 * HOUR)},"
    f" x AS (SELECT i.type, i.usr, i.j, i.value AS l, r.value AS r FROM i JOIN"
    " (SELECT type, usr, j, avg(value) AS value FROM w GROUP BY type, usr, j) r USING (type, usr, j))"
)


def _two(t):
    return R.instant(t.gauge, HOURLY, "6h"), R.over_time(t.gauge, "avg", "6h", HOURLY)


@query(
    "a4_binop_one_to_one",
    f"WITH {TWO} SELECT type, usr, {T}, CASE WHEN r = 0 AND l = 0 THEN 'NaN' WHEN r = 0 THEN 'Inf'"
    " ELSE CAST(CAST(round(l / r * 1000) AS BIGINT) AS VARCHAR) END AS value FROM x",
)
def _(t):
    found = binop("/", *_two(t))
    return found.select(label("type").alias("type"), label("usr").alias("usr"), seconds("ts").alias("t"), special_text(F.col("value"), 1000).alias("value"))


@query(
    "a4_unmatched_duplicates",
    f"WITH {UP}, {windowed(HOUR)}, {latest('instance, site')}, m AS (SELECT instance, j, max(value) AS v, count(*) AS n FROM i WHERE CAST(instance AS INTEGER) < 10 GROUP BY instance, j)"
    f" SELECT instance, {T}, 2 * v AS value FROM m",
)
def _(t):
    """Series that differ in an ignored label alone are no error while they have no partner."""
    up = R.instant(t.up, HOURLY, "1h")
    number = F.col("labels")["instance"].cast("int")
    other = up.filter(number >= 10).withColumn("labels", F.map_concat("labels", F.create_map(F.lit("copy"), F.lit("b"))))
    left = up.unionByName(rekey(other))
    right = up.filter(number < 10)
    return out(binop("+", left, right, on=["instance"]), "instance")


@query("a8_compare_vectors", f"WITH {TWO} SELECT type, usr, {T}, round(l, 6) AS value FROM x WHERE l > r")
def _(t):
    return out(binop(">", *_two(t)), "type", "usr")


@query(
    "a8_compare_vectors_bool",
    f"WITH {TWO} SELECT type, usr, {T}, CASE WHEN l > r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM x",
)
def _(t):
    a, b = _two(t)
    # averages of one sample equal it exactly in both engines
    return out(binop(">", a, b, as_bool=True), "type", "usr")


@query("a6_chained_add", f"WITH {TWO} SELECT type, usr, {T}, round(l + r + l, 6) AS value FROM x")
def _(t):
    a, b = _two(t)
    return out(binop("+", binop("+", a, b), a), "type", "usr")


BY_TYPE = (
    f"{instant_cte(GAUGE, 'type, usr', 6 * HOUR)},"
    " y AS (SELECT type, j, sum(value) AS value FROM i GROUP BY type, j)"
)


@query(
    "a5_binop_ignoring",
    f"WITH {BY_TYPE}, z AS (SELECT type, j, count(*) AS n FROM w GROUP BY type, j)"
    f" SELECT type, {T}, round(y.value - z.n, 6) AS value FROM y JOIN z USING (type, j)",
)
def _(t):
    from tideline.operators.relabel import label_set

    left = agg(R.instant(t.gauge, HOURLY, "6h"), "sum", ["type"])
    counts = agg(R.over_time(t.gauge, "count", "6h", HOURLY), "sum", ["type"])
    return out(binop("-", left, label_set(counts, "origin", "events"), ignoring=["origin"]), "type")


@query(
    "a13_scalar",
    f"WITH {BY_TYPE}, {GRID}, k AS (SELECT j, count(*) AS n, max(value) AS v FROM y WHERE type = 'error' GROUP BY j)"
    f" SELECT {T}, CASE WHEN n = 1 THEN round(v, 6) END AS value FROM g LEFT JOIN k USING (j)",
)
def _(t):
    found = agg(R.instant(P.select(t.gauge, None, P.eq("type", "error")), HOURLY, "6h"), "sum", ["type"])
    value = F.when(~F.isnan("value"), F.round("value", 6))
    return A.scalar(found, HOURLY.instants(t.spark)).select(seconds("ts").alias("t"), value.alias("value"))


@query(
    "a14_absent",
    f"WITH {instant_cte(GAUGE, 'type, usr')}, {GRID}"
    f" SELECT 'error' AS type, {T}, 1.0::DOUBLE AS value FROM g"
    " WHERE j NOT IN (SELECT j FROM i WHERE type = 'error' AND regexp_full_match(usr, '1.*'))",
)
def _(t):
    selector = P.sel("event_value", P.eq("type", "error"), P.rx("usr", "1.*"))
    return out(A.absent(R.instant(t.gauge, HOURLY, "1h"), selector, HOURLY.instants(t.spark)), "type")


@query(
    "a15_absent_over_time",
    f"WITH {GAUGE}, {windowed(2 * HOUR)}, {GRID}"
    f" SELECT 'signup' AS type, {T}, 1.0::DOUBLE AS value FROM g"
    " WHERE j NOT IN (SELECT j FROM w WHERE type = 'signup' AND usr <> '3')",
)
def _(t):
    selector = P.sel("event_value", P.eq("type", "signup"), P.ne("usr", "3"))
    return out(A.absent_over_time(t.gauge, selector, "2h", HOURLY), "type")


@query(
    "a16_float_division",
    f"WITH {UP}, {windowed(HOUR)},"
    " k AS (SELECT instance, j, sum(1 - value) AS bad, sum(value) AS ok FROM w GROUP BY instance, j)"
    f" SELECT instance, {T}, CASE WHEN ok = 0 AND bad = 0 THEN 'NaN' WHEN ok = 0 THEN 'Inf'"
    " ELSE CAST(CAST(round(bad / ok * 1000) AS BIGINT) AS VARCHAR) END AS value FROM k",
)
def _(t):
    plain = t.up.withColumn("labels", F.map_filter("labels", lambda k, _: k == "instance"))
    from tideline.model import rekey

    series = rekey(plain)
    ok = R.over_time(series, "sum", "1h", HOURLY)
    bad = R.over_time(A.rarith(1, "-", series), "sum", "1h", HOURLY)
    text = special_text(F.col("value"), 1000)
    found = binop("/", bad, ok)
    return found.select(F.col("labels")["instance"].alias("instance"), seconds("ts").alias("t"), text.alias("value"))
