"""Warehouse reports and their relational operators."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from checks.measurements import (
    AUDIT,
    BILLS,
    INVALID,
    audit,
    bills,
    flat,
    flat_sql,
    request_log,
    tests,
)
from checks.registry import EVENTS_ASOF, ORDERS_ASOF, query
from tideline.functions import scalars as S
from tideline.operators import joins as J
from tideline.operators import select as P
from tideline.operators import tables as U
from tideline.plans.reports import run_report
from tideline.sources.gauges import report_series, report_to_samples
from tideline.sources.warehouse import nested, scan, scan_shards

DAY2 = "DATE '2001-06-28'"
YEAR = "DATE '2000-06-30'"
FIRST, LAST = date(2000, 1, 1), date(2001, 6, 30)
BETWEEN = "date BETWEEN DATE '2000-01-01' AND DATE '2001-06-30'"


def union_sql(columns: str, tag: str = "datatype") -> str:
    parts = [
        f"SELECT '{n}' AS {tag}, {columns} FROM ({flat_sql(n)})" for n in ("lines", "orders", "events")
    ]
    return "u AS (" + " UNION ALL ".join(parts) + ")"


def three(t) -> dict:
    return {n: tests(t, n) for n in ("lines", "orders", "events")}


def text_date(df, *columns):
    for c in columns or ("date",):
        df = df.withColumn(c, F.col(c).cast("string"))
    return df


@query(
    "q1_annotation_coverage",
    f"WITH {union_sql('date, lat, lon, systems')}, x AS (SELECT *, unnest(CASE systems WHEN 0 THEN [NULL] WHEN 1 THEN [1] ELSE [0, 2] END) AS n FROM u)"
    " SELECT datatype, count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS value_geo_success,"
    f" count(*) FILTER (n > 0) AS value_asn_success, count(*) AS value_total FROM x WHERE date = {DAY2} GROUP BY datatype",
)
def _(t):
    return run_report("annotation_coverage", tables=three(t), asof=ORDERS_ASOF)


BILL_SERVICES = {"storage": "PROMO", "warehouse": "SMALL", "compute": "LARGE"}


def _bill_sql() -> str:
    period = (
        "CASE WHEN CAST(ts AS DATE) = DATE '2001-06-30' THEN 'today' WHEN CAST(ts AS DATE) = DATE '2001-06-29' THEN 'yesterday'"
        " WHEN CAST(ts AS DATE) = DATE '2001-06-28' THEN 'before_yesterday' ELSE 'month' END"
    )
    parts = [
        f"round({f} * coalesce(sum(cost) FILTER (period = 'month'), 0), 2) AS value_average_{n}"
        for n, f in {"daily": "1 / 30", "monthly": "1", "annual": "365 / 30"}.items()
    ]
    for suffix, service in BILL_SERVICES.items():
        parts.append(
            f"round(coalesce(sum(cost) FILTER (period = 'month' AND service = '{service}'), 0) / 30, 2) AS value_average_daily_{suffix}"
        )
        for p in ("today", "yesterday", "before_yesterday"):
            parts.append(
                f"round(coalesce(sum(cost) FILTER (period = '{p}' AND service = '{service}'), 0), 2) AS value_{p}_{suffix}"
            )
    return (
        f"WITH {BILLS}, p AS (SELECT *, {period} AS period FROM bills WHERE CAST(ts AS DATE) BETWEEN DATE '2001-05-30' AND DATE '2001-06-30'"
        f" AND project IS NOT NULL) SELECT {', '.join(parts)} FROM p"
    )


@query("q2_billing", _bill_sql())
def _(t):
    df = run_report("billing", bills=bills(t), asof=ORDERS_ASOF, services=BILL_SERVICES)
    return df.select(*[F.round(c, 2).alias(c) for c in df.columns])


@query(
    "q3_daily_archives",
    f"WITH {union_sql('date, url')} SELECT datatype, count(DISTINCT url) AS value_count FROM u WHERE date = {DAY2} GROUP BY datatype",
)
def _(t):
    return run_report("daily_archives", tables=three(t), asof=ORDERS_ASOF)


@query(
    "q4_access_counts",
    f"WITH {union_sql('date')} SELECT datatype, count(*) AS value_total FROM u WHERE date = {DAY2} GROUP BY datatype",
)
def _(t):
    return run_report("access_counts", tables=three(t), asof=ORDERS_ASOF)


@query(
    "q5_cumulative_tests",
    "WITH a AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1),"
    " b AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1),"
    " c AS (SELECT d, a.n + b.n AS n FROM a JOIN b USING (d) WHERE d > DATE '2001-06-30' - 180)"
    " SELECT CAST(-row_number() OVER (ORDER BY d DESC) AS VARCHAR) AS le, CAST(sum(n) OVER (ORDER BY d) AS BIGINT) AS value_count FROM c",
)
def _(t):
    return run_report("cumulative_tests", first=tests(t, "lines"), second=tests(t, "orders"), asof=ORDERS_ASOF)


AGES = {"day": 24, "7_days": 168, "30_days": 720, "90_days": 2160}


def _freshness_sql() -> str:
    ages = "".join(
        f", count(*) FILTER (stale AND age < {h}) AS value_dates_partially_parsed_last_{n}"
        f", count(*) FILTER (NOT stale AND age < {h}) AS value_dates_fully_parsed_last_{n}"
        for n, h in AGES.items()
    )
    rows = "CAST(round(sum(n) FILTER ({0}) / nullif(count(*) FILTER ({0}), 0)) AS BIGINT)"
    four, thirty = "days <= 4", "days <= 30"
    return (
        f"WITH {union_sql('id, date, parsed')}, d AS (SELECT datatype, date, count(id) AS n,"
        " datesub('hour', max(parsed), TIMESTAMP '2001-06-30') AS age,"
        " datesub('hour', min(parsed), max(parsed)) > 24 AS stale, DATE '2001-06-30' - date AS days"
        f" FROM u WHERE date > {YEAR} GROUP BY datatype, date) SELECT datatype, count(date) AS value_total_dates,"
        f" {rows.format(four)} AS value_rows_per_date_last_4_dates, {rows.format(thirty)} AS value_rows_per_date_last_30_dates,"
        f" count(*) FILTER (age < 96 AND {four}) AS value_daily_done_last_4_days,"
        f" count(*) FILTER (stale) AS value_dates_partially_parsed{ages} FROM d GROUP BY datatype"
    )


@query("q6_parse_freshness", _freshness_sql())
def _(t):
    return run_report("parse_freshness", tables=three(t), asof=ORDERS_ASOF)


@query(
    "q7_historical_throughput",
    f"WITH {union_sql('date, parsed')}, p AS (SELECT datatype, count(DISTINCT date) AS n FROM u WHERE date > {YEAR}"
    " AND parsed BETWEEN TIMESTAMP '2001-06-29' AND TIMESTAMP '2001-06-30' AND date < CAST(parsed AS DATE) - 1 GROUP BY datatype)"
    " SELECT 'shop' AS experiment, datatype, coalesce(n, 0) AS value_throughput FROM"
    f" (SELECT DISTINCT datatype FROM u WHERE date > {YEAR}) LEFT JOIN p USING (datatype)",
)
def _(t):
    named = {("shop", n): df for n, df in three(t).items()}
    return run_report("historical_throughput", tables=named, asof=ORDERS_ASOF)


@query(
    "q8_parse_age",
    f"WITH {union_sql('date, parsed')} SELECT datatype, round(datesub('second', min(parsed), TIMESTAMP '2001-06-30') / 86400.0, 6) AS value_age_days"
    f" FROM u WHERE date > {YEAR} GROUP BY datatype",
)
def _(t):
    df = run_report("parse_age", tables=three(t), asof=ORDERS_ASOF)
    return df.select("datatype", F.round("value_age_days", 6).alias("value_age_days"))


LOG_START = "TIMESTAMP '2024-01-28 00:05:00' - to_minutes(CAST(conv_id % 40 AS INTEGER))"


@query(
    "q9_rate_limit_hits",
    f"SELECT count(*) AS value FROM conversations WHERE {LOG_START} > TIMESTAMP '2024-01-27 23:50:00'"
    f" AND {LOG_START} <= TIMESTAMP '2024-01-27 23:55:00' AND starts_with(role || ': ' || text, 'user')",
)
def _(t):
    asof = datetime(2024, 1, 28, 0, 5)
    return run_report("rate_limit_hits", log=request_log(t), asof=asof, signature="user")


def _flat_tests(t, name):
    return flat(t, name).selectExpr("date", "uuid", "ts AS tstart", "ended AS tend", "machine", "site")


def _switch(t):
    return flat(t, "orders").selectExpr(
        "date", "machine", "site", "ts AS collected", "CASE WHEN rate > 2000 THEN rate ELSE 0 END AS discards"
    )


Q10_DAY = "DATE '2001-06-28'"


@query(
    "q10_tests_with_discards",
    f"WITH n AS (SELECT 'lines' AS src, * FROM ({flat_sql('lines')}) UNION ALL SELECT 'orders' AS src, * FROM ({flat_sql('orders')})),"
    f" te AS (SELECT concat_ws('-', CASE WHEN site IS NULL THEN NULL ELSE machine END, site) AS node, uuid, site, ts, ended FROM n"
    f" WHERE date = {Q10_DAY} AND uuid IS NOT NULL AND uuid <> '{INVALID}'),"
    f" sw AS (SELECT machine || '-' || site AS node, ts - INTERVAL 10 SECOND AS s, ts AS e FROM ({flat_sql('orders')}) WHERE date = {Q10_DAY} AND rate > 2000),"
    " hit AS (SELECT DISTINCT uuid FROM te JOIN sw ON te.node = sw.node AND (ts BETWEEN s AND e OR ended BETWEEN s AND e))"
    " SELECT substr(site, 1, 3) AS metro, site, CASE WHEN site IS NULL THEN NULL ELSE node END AS node,"
    " count(*) FILTER (uuid IN (SELECT uuid FROM hit)) AS value_with_discards, count(*) AS value_total FROM te GROUP BY ALL",
)
def _(t):
    sources = {n: _flat_tests(t, n) for n in ("lines", "orders")}
    return run_report(
        "tests_with_discards",
        tests=sources,
        switch=_switch(t),
        asof=datetime(2001, 6, 30, 12),
        poll=timedelta(seconds=10),
        invalid=INVALID,
        metro="^(.{3})",
    )


@query(
    "q11_sidecar_coverage",
    f"WITH a AS ({flat_sql('lines')}), b AS ({flat_sql('orders')}) SELECT a.site, count(*) AS value_total, count(b.id) AS value_matching"
    f" FROM (SELECT * FROM a WHERE date = {DAY2}) a LEFT JOIN (SELECT * FROM b WHERE date = {DAY2}) b ON a.id = b.id WHERE a.site IS NOT NULL"
    " GROUP BY a.site HAVING count(*) > 1",
)
def _(t):
    return run_report(
        "sidecar_coverage", tests=tests(t, "lines"), traces=tests(t, "orders"), asof=ORDERS_ASOF, more_than=1
    )


@query("q12_recent_rows", "SELECT count(*) AS value_total FROM events WHERE ts > TIMESTAMP '2024-01-27'")
def _(t):
    return run_report("recent_rows", tests=tests(t, "events"), asof=EVENTS_ASOF)


@query(
    "q13_hourly_by_site",
    f"WITH u AS (SELECT ts, site, date FROM ({flat_sql('events')}) UNION ALL SELECT ts, site, date FROM ({flat_sql('orders')}))"
    " SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time, site AS metric, count(*) AS total FROM u"
    " WHERE date BETWEEN DATE '2001-01-01' AND DATE '2024-01-20' AND regexp_matches(site, 'lga|nrt01') GROUP BY ALL",
)
def _(t):
    df = run_report(
        "hourly_by_site",
        tables={n: tests(t, n) for n in ("events", "orders")},
        first=date(2001, 1, 1),
        last=date(2024, 1, 20),
        site_regex="lga|nrt01",
    )
    return df.withColumn("time", F.unix_seconds("time"))


@query(
    "q14_metros",
    f"WITH a AS ({flat_sql('lines')}), b AS ({flat_sql('orders')}), s AS (SELECT DISTINCT site FROM a WHERE date BETWEEN DATE '2001-06-29' AND DATE '2001-06-30'"
    " AND site IS NOT NULL UNION ALL SELECT DISTINCT site FROM b WHERE date BETWEEN DATE '2001-06-29' AND DATE '2001-06-30' AND site IS NOT NULL AND url LIKE '%org1%')"
    " SELECT substr(site, 1, 3) AS metro FROM s",
)
def _(t):
    return run_report(
        "metros", core=tests(t, "lines"), hosted=tests(t, "orders"), asof=ORDERS_ASOF, org="org1", core_org="org1"
    )


@query(
    "q15_client_names",
    f"WITH a AS ({flat_sql('lines')}) SELECT CAST(date AS VARCHAR) AS date, coalesce(client_name, 'UNNAMED') AS metric, count(*) AS total FROM a"
    f" WHERE {BETWEEN} AND uuid IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 5",
)
def _(t):
    return text_date(run_report("client_names", tests=tests(t, "lines"), first=FIRST, last=LAST, more_than=5))


@query(
    "q16_machine_types",
    f"WITH a AS ({flat_sql('lines')}), c AS (SELECT date, machine_type AS metric, count(*) AS n FROM a WHERE {BETWEEN} AND uuid IS NOT NULL AND site IS NOT NULL GROUP BY 1, 2)"
    " SELECT CAST(date AS VARCHAR) AS date, metric, round(n / sum(n) OVER (PARTITION BY date), 6) AS ratio FROM c",
)
def _(t):
    df = run_report("machine_types", tests=tests(t, "lines"), first=FIRST, last=LAST)
    return text_date(df).withColumn("ratio", F.round("ratio", 6))


@query(
    "q17_site_zones",
    f"WITH a AS ({flat_sql('lines')}) SELECT CAST(date AS VARCHAR) AS date, site || '-' || zone AS metric, count(*) AS total FROM a"
    f" WHERE {BETWEEN} AND uuid IS NOT NULL AND site IS NOT NULL GROUP BY 1, 2",
)
def _(t):
    return text_date(run_report("site_zones", tests=tests(t, "lines"), first=FIRST, last=LAST))


@query(
    "q18_same_country",
    f"WITH a AS ({flat_sql('lines')}) SELECT CAST(date AS VARCHAR) AS date, country AS metric, count(*) AS total FROM a"
    f" WHERE {BETWEEN} AND uuid IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND country = s_country GROUP BY 1, 2",
)
def _(t):
    return text_date(run_report("same_country", tests=tests(t, "lines"), first=FIRST, last=LAST))


@query(
    "q19_rate_map",
    f"WITH a AS ({flat_sql('lines')}) SELECT lat AS latitude, lon AS longitude, round(quantile_disc(rate, 0.5), 6) AS value FROM a"
    f" WHERE {BETWEEN} AND uuid IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY lat, lon HAVING count(*) > 10"
    " ORDER BY lat, lon LIMIT 2500",
)
def _(t):
    df = run_report("rate_map", tests=tests(t, "lines"), first=FIRST, last=LAST)
    return df.withColumn("value", F.round("value", 6))


FROM_MS, TO_MS = 1704153600000, 1706400000000
RANGE = "ts BETWEEN make_timestamp(1704153600000000) AND make_timestamp(1706400000000000)"
STORAGE = (
    f"{RANGE} AND usr IS NOT NULL AND action LIKE 'storage.%.%' AND usr NOT LIKE '%robots.example'"
    r" AND regexp_extract(resource, '\d{4}/\d{2}/\d{2}') <= '2024/01/25' AND resource <> 'bucket/none'"
)
STORAGE_PARAMS = {
    "from_ms": FROM_MS,
    "to_ms": TO_MS,
    "asof": EVENTS_ASOF,
    "method": "storage.%.%",
    "robots": "%robots.example",
    "days": 3,
    "dated": "[12][0-9]+/[0-9]+/[0-9]+",
}


def _hour(df):
    return df.withColumn("time", F.unix_seconds("time"))


HOUR_T = "CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS time"


@query(
    "q20_queries_per_user_hour",
    f'WITH {AUDIT} SELECT {HOUR_T}, usr AS "user", count(*) AS total FROM audit WHERE {RANGE} AND usr IS NOT NULL AND service = \'view\' GROUP BY ALL',
)
def _(t):
    return _hour(
        run_report("queries_per_user_hour", log=audit(t), from_ms=FROM_MS, to_ms=TO_MS, service="view")
    )


@query(
    "q21_storage_per_user_hour",
    f'WITH {AUDIT} SELECT {HOUR_T}, usr AS "user", count(*) AS total FROM audit WHERE {STORAGE} GROUP BY ALL',
)
def _(t):
    return _hour(run_report("storage_per_user_hour", log=audit(t), **STORAGE_PARAMS))


@query(
    "q21_storage_per_user",
    f'WITH {AUDIT} SELECT usr AS "user", count(*) AS total FROM audit WHERE {STORAGE} GROUP BY ALL',
)
def _(t):
    return run_report("storage_per_user", log=audit(t), **STORAGE_PARAMS)


@query(
    "q21_storage_per_action_hour",
    f'WITH {AUDIT} SELECT {HOUR_T}, usr AS "user", action, count(*) AS total FROM audit WHERE {STORAGE} GROUP BY ALL',
)
def _(t):
    return _hour(run_report("storage_per_action_hour", log=audit(t), **STORAGE_PARAMS))


@query(
    "q22_storage_cost",
    f"WITH {BILLS} SELECT {HOUR_T}, sku, round(sum(cost), 2) AS cost FROM bills WHERE service LIKE '%MA%'"
    " AND ts BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2001-06-30' GROUP BY ALL",
)
def _(t):
    df = run_report("storage_cost", bills=bills(t), from_ms=946684800000, to_ms=993859200000, service="%MA%")
    return _hour(df).withColumn("cost", F.round("cost", 2))


@query(
    "q23_storage_listing",
    f'WITH {AUDIT} SELECT epoch_us(ts) AS us, usr AS "user", action, service, resource FROM audit WHERE {STORAGE}',
)
def _(t):
    df = run_report("storage_listing", log=audit(t), **STORAGE_PARAMS)
    return df.select(F.unix_micros("timestamp").alias("us"), "user", "action", "service", "resource")


def _dist_cte(bins: int, where: str, source: str = "lines") -> str:
    step = f"((ln(1100) - ln(9)) / {bins})"
    return (
        f"a AS ({flat_sql(source)}), r AS (SELECT site, CAST(least(floor((ln(least(greatest(rate, 9), 1100)) - ln(9)) / {step}), {bins - 1}) AS BIGINT) AS bin"
        f" FROM a WHERE {where} AND site IS NOT NULL), c AS (SELECT site, bin, count(*) AS n FROM r GROUP BY ALL),"
        f" d AS (SELECT site, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT site FROM c) CROSS JOIN (SELECT unnest(generate_series(0, {bins - 1})) AS bin) b"
        f" LEFT JOIN c USING (site, bin)), f AS (SELECT site, round(exp(ln(9) + (bin + 1) * {step}), 4) AS xright,"
        " round(n / sum(n) OVER (PARTITION BY site), 6) AS pdf, round(sum(n) OVER (PARTITION BY site ORDER BY bin) / sum(n) OVER (PARTITION BY site), 6) AS cdf FROM d)"
    )


def _dist(t, mode, mask=None, sources=("lines",), regex="lga|nrt"):
    tables = {n: flat(t, n) for n in sources}
    df = run_report(
        "performance_distribution",
        tables=tables,
        low=9.0,
        high=1100.0,
        metric="rate",
        first=FIRST,
        last=LAST,
        site_regex=regex,
        mode=mode,
        mask=mask,
    )
    return df.select(F.round("xright", 4).alias("xright"), F.round("data", 6).alias("data"), "site", "store")


DIST_WHERE = f"{BETWEEN} AND regexp_matches(site, 'lga|nrt')"


@query(
    "q24_distribution_pdf",
    f"WITH {_dist_cte(50, DIST_WHERE)} SELECT xright, pdf AS data, site, 'lines' AS store FROM f",
)
def _(t):
    return _dist(t, "pdf")


@query(
    "h3_distribution_cdf",
    f"WITH {_dist_cte(50, DIST_WHERE)} SELECT xright, cdf AS data, site, 'lines' AS store FROM f",
)
def _(t):
    return _dist(t, "cdf")


@query(
    "h4_distribution_masked",
    "WITH " + _dist_cte(50, DIST_WHERE + " AND machine_type = 'physical'") + " SELECT xright, pdf AS data, site, 'lines' AS store FROM f",
)
def _(t):
    return _dist(t, "pdf", mask=F.col("machine_type") == "physical")


@query(
    "h5_distribution_two_stores",
    "SELECT * FROM (WITH " + _dist_cte(50, DIST_WHERE) + " SELECT xright, pdf AS data, site, 'lines' AS store FROM f)"
    " UNION ALL SELECT * FROM (WITH " + _dist_cte(50, DIST_WHERE, "orders") + " SELECT xright, pdf AS data, site, 'orders' AS store FROM f)",
)
def _(t):
    return _dist(t, "pdf", sources=("lines", "orders"))


@query(
    "h18_series_arrays",
    f"WITH {_dist_cte(50, DIST_WHERE)} SELECT site, array_to_string(list(CAST(CAST(round(pdf * 1e6) AS BIGINT) AS VARCHAR) ORDER BY xright), ',') AS y FROM f GROUP BY site",
)
def _(t):
    from tideline.operators.panels import series_arrays

    frame = _dist(t, "pdf").withColumn("y6", F.round(F.col("data") * 1e6).cast("bigint").cast("string"))
    return series_arrays(frame, "site", "xright", "y6").select("site", F.concat_ws(",", "y").alias("y"))


@query(
    "q25_hourly_tests",
    f"WITH a AS ({flat_sql('events')}) SELECT {HOUR_T}, site AS metric, count(*) AS total FROM a WHERE {RANGE} AND regexp_matches(site, 'a') GROUP BY ALL",
)
def _(t):
    tests_ = flat(t, "events").withColumnRenamed("ts", "TestTime")
    return _hour(run_report("hourly_tests", tests=tests_, from_ms=FROM_MS, to_ms=TO_MS, site_regex="a"))


# --- relational operators ------------------------------------------------------------


@query(
    "s6_date_scan",
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31' GROUP BY 1",
)
def _(t):
    df = scan(t.spark, f"{t.dir}/orders.parquet", datetime(1998, 1, 1), datetime(1999, 12, 31), "o_orderdate")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s7_shard_scan",
    f"SELECT strftime({LOG_START}, '%Y%m%d') AS table_suffix, count(*) AS lines FROM conversations GROUP BY 1",
)
def _(t):
    log = scan_shards(request_log(t), [date(2024, 1, 28), date(2024, 1, 27)])
    return log.groupBy("table_suffix").agg(F.sum(F.size("line")).alias("lines"))


@query(
    "s8_nested_scan",
    f"WITH a AS ({flat_sql('orders')}) SELECT id, lat, country, uuid FROM a",
)
def _(t):
    return nested(
        tests(t, "orders"), id="id", lat="client.Geo.Latitude", country="client.Geo.CountryCode", uuid="raw.Download.UUID"
    )


@query(
    "s9_report_to_samples",
    f"WITH {union_sql('date, url')}, r AS (SELECT datatype, count(DISTINCT url) AS a, count(*) AS n FROM u WHERE date = {DAY2} GROUP BY datatype)"
    " SELECT 'archives_count' AS metric, datatype, CAST(a AS DOUBLE) AS value FROM r UNION ALL SELECT 'archives' AS metric, datatype, CAST(n AS DOUBLE) FROM r",
)
def _(t):
    counts = run_report("daily_archives", tables=three(t), asof=ORDERS_ASOF)
    rows = run_report("access_counts", tables=three(t), asof=ORDERS_ASOF).withColumnRenamed("value_total", "value")
    v = report_to_samples(counts.join(rows, "datatype"), "archives", F.lit(ORDERS_ASOF))
    return v.select("metric", F.col("labels")["datatype"].alias("datatype"), "value")


@query(
    "s10_report_series",
    "WITH r AS (SELECT event_type AS type, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2),"
    " g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 3 HOUR)) AS t)"
    " SELECT type, CAST(epoch(t) AS BIGINT) AS t, CAST(arg_max(n, d) AS DOUBLE) AS value FROM r JOIN g ON CAST(d AS TIMESTAMP) + INTERVAL 1 DAY <= t GROUP BY type, t",
)
def _(t):
    from tideline.model import Grid
    from tideline.sources.samples import samples_from

    daily = t.ev.groupBy("event_type", F.date_add(F.to_date("ts"), 1).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    runs = samples_from(daily, "report", {"type": F.col("event_type")}, "run", F.col("n"))
    held = report_series(runs, Grid.of(datetime(2024, 1, 1), datetime(2024, 1, 31), "3h"))
    return held.select(F.col("labels")["type"].alias("type"), F.unix_seconds("ts").alias("t"), "value")


@query(
    "s10_report_series_vanishing",
    "WITH r AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2),"
    " x AS (SELECT d, lead(d) OVER (ORDER BY d) AS nd FROM (SELECT DISTINCT d FROM r)),"
    " g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 6 HOUR)) AS t)"
    " SELECT CAST(user_id AS VARCHAR) AS usr, CAST(epoch(t) AS BIGINT) AS t, CAST(n AS DOUBLE) AS value FROM r JOIN x USING (d)"
    " JOIN g ON t >= CAST(d AS TIMESTAMP) + INTERVAL 1 DAY AND (nd IS NULL OR t < CAST(nd AS TIMESTAMP) + INTERVAL 1 DAY)",
)
def _(t):
    """Users that a day lacks end with that day's run and come back later."""
    from tideline.model import Grid
    from tideline.sources.samples import samples_from

    daily = t.ev.groupBy("user_id", F.date_add(F.to_date("ts"), 1).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    runs = samples_from(daily, "report", {"usr": F.col("user_id")}, "run", F.col("n"))
    held = report_series(runs, Grid.of(datetime(2024, 1, 1), datetime(2024, 1, 31), "6h"))
    return held.select(F.col("labels")["usr"].alias("usr"), F.unix_seconds("ts").alias("t"), "value")


@query(
    "s15_parameterised_report",
    f"WITH {union_sql('date')} SELECT datatype, count(*) AS value_total FROM u WHERE date = DATE '1999-03-13' GROUP BY datatype",
)
def _(t):
    return run_report("access_counts", tables=three(t), asof=datetime(1999, 3, 15))


@query("p8_time_range", f"SELECT event_id FROM events WHERE {RANGE}")
def _(t):
    return P.time_range(t.ev, "ts", FROM_MS, TO_MS).select("event_id")


@query(
    "p9_date_window",
    "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-05-30' AND DATE '2001-06-30'",
)
def _(t):
    df = t.orders.withColumn("d", F.to_date("o_orderdate"))
    return P.date_window(df, "d", ORDERS_ASOF.date(), 31).select("o_orderkey")


@query(
    "p10_lag_slice",
    "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-27' AND ts <= TIMESTAMP '2024-01-27 12:00:00'",
)
def _(t):
    return P.lag_slice(t.ev, "ts", EVENTS_ASOF, timedelta(hours=24), timedelta(hours=12)).select("event_id")


@query(
    "p11_like",
    "SELECT p_partkey FROM part WHERE p_type LIKE '%MA%' AND p_brand NOT LIKE '%1'",
)
def _(t):
    return t.part.filter(F.col("p_type").like("%MA%") & ~F.col("p_brand").like("%1")).select("p_partkey")


@query("p12_regexp_contains", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'A[NL]|^S')")
def _(t):
    return t.part.filter(F.col("p_type").rlike("A[NL]|^S")).select("p_partkey")


@query("p13_starts_with", "SELECT page_id FROM pages WHERE starts_with(url, 'https://m.')")
def _(t):
    return t.pages.filter(F.col("url").startswith("https://m.")).select("page_id")


@query("p14_optional_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def _(t):
    high = P.maybe(300000, F.col("o_totalprice") > 300000)
    return t.orders.filter(high & P.maybe(0, F.col("o_orderstatus") == "F")).select("o_orderkey")


@query(
    "p15_null_and_sentinel",
    f"WITH a AS ({flat_sql('orders')}) SELECT uuid FROM a WHERE uuid IS NOT NULL AND uuid <> '{INVALID}'",
)
def _(t):
    return flat(t, "orders").filter(F.col("uuid").isNotNull() & (F.col("uuid") != INVALID)).select("uuid")


@query(
    "p16_periods",
    "SELECT CASE WHEN d = DATE '2001-06-30' THEN 'today' WHEN d = DATE '2001-06-29' THEN 'yesterday'"
    " WHEN d = DATE '2001-06-28' THEN 'before_yesterday' WHEN d <= DATE '2001-06-30' THEN 'month' END AS period, count(*) AS n"
    " FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1",
)
def _(t):
    period = P.period_of(F.col("o_orderdate"), ORDERS_ASOF.date()).alias("period")
    return t.orders.groupBy(period).agg(F.count(F.lit(1)).alias("n"))


@query("p17_literal_tag", "SELECT 'orders' AS datatype, o_orderkey FROM orders")
def _(t):
    return P.tag(t.orders.select("o_orderkey"), "datatype", "orders")


@query("p18_choose_column", "SELECT o_orderkey, o_totalprice AS data FROM orders")
def _(t):
    return t.orders.select("o_orderkey", P.choose("cdf", F.col("o_custkey"), F.col("o_totalprice")).alias("data"))


@query(
    "p19_same_field",
    f"WITH a AS ({flat_sql('orders')}) SELECT id FROM a WHERE country = s_country AND lat IS NOT NULL AND uuid IS NOT NULL",
)
def _(t):
    df = flat(t, "orders")
    return df.filter(P.same_field(F.col("country"), F.col("s_country"), F.col("lat"), F.col("uuid"))).select("id")


@query(
    "j9_join_using_date",
    "WITH a AS (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS m FROM orders GROUP BY 1)"
    " SELECT CAST(d AS VARCHAR) AS date, n + m AS total FROM a JOIN b USING (d)",
)
def _(t):
    a = t.lineitem.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    b = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("m"))
    return text_date(a.join(b, "date").select("date", (F.col("n") + F.col("m")).alias("total")))


@query(
    "j10_coverage",
    "SELECT lang, count(*) AS value_total, count(l.doc_id) AS value_matching FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang",
)
def _(t):
    return J.coverage(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "lang")


@query(
    "j11_zero_fill",
    "SELECT source, count(l.doc_id) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND toxic = 1 GROUP BY source",
)
def _(t):
    toxic = t.documents.join(t.labels.filter("toxic = 1"), "doc_id")
    counts = toxic.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return J.zero_fill(t.documents, counts, ["source"], "n")


TOUCH = (
    "t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 100 AS node, l_shipdate AS s, l_shipdate + to_hours(CAST(l_quantity AS INTEGER)) AS e FROM lineitem),"
    " p AS (SELECT DISTINCT o_custkey % 100 AS node, o_orderdate - INTERVAL 1 DAY AS s, o_orderdate AS e FROM orders)"
)


def _touch_inputs(t):
    tests_ = t.lineitem.selectExpr(
        "l_orderkey * 10 + l_linenumber AS id",
        "l_suppkey % 100 AS node",
        "CAST(l_shipdate AS timestamp) AS tstart",
        "CAST(l_shipdate AS timestamp) + make_interval(0, 0, 0, 0, CAST(l_quantity AS int)) AS tend",
    )
    polls = t.orders.selectExpr(
        "o_custkey % 100 AS node",
        "CAST(o_orderdate AS timestamp) - INTERVAL 1 DAY AS tstart",
        "CAST(o_orderdate AS timestamp) AS tend",
    )
    return tests_, polls.distinct()


@query(
    "j12_interval_touch",
    f"WITH {TOUCH} SELECT t.id, t.node FROM t SEMI JOIN p ON t.node = p.node AND (t.s BETWEEN p.s AND p.e OR t.e BETWEEN p.s AND p.e)",
)
def _(t):
    tests_, polls = _touch_inputs(t)
    return J.interval_touch_semi(tests_, polls, "1d").select("id", "node")


@query(
    "j12_interval_touch_repeated",
    f"WITH {TOUCH}, r AS (SELECT node, s, e FROM t UNION ALL SELECT node, s, e FROM t) SELECT r.node, CAST(epoch(r.s) AS BIGINT) AS s FROM r"
    " SEMI JOIN p ON r.node = p.node AND (r.s BETWEEN p.s AND p.e OR r.e BETWEEN p.s AND p.e)",
)
def _(t):
    """Equal rows are all kept."""
    tests_, polls = _touch_inputs(t)
    twice = tests_.drop("id").unionByName(tests_.drop("id"))
    return J.interval_touch_semi(twice, polls, "1d").select("node", F.unix_seconds("tstart").alias("s"))


@query(
    "j12_interval_touch_pairs",
    f"WITH {TOUCH} SELECT t.id, t.node, CAST(epoch(p.e) AS BIGINT) AS poll_end FROM t JOIN p ON t.node = p.node AND (t.s BETWEEN p.s AND p.e OR t.e BETWEEN p.s AND p.e)",
)
def _(t):
    tests_, polls = _touch_inputs(t)
    polls = polls.withColumn("poll_end", F.unix_seconds("tend"))
    return J.interval_touch_join(tests_, polls, "1d").select("id", "node", "poll_end")


@query(
    "j13_flag_in",
    "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'true' ELSE 'false' END AS flag FROM documents",
)
def _(t):
    return J.flag_in(t.documents.select("doc_id"), t.labels.filter("quality = 1"), "doc_id")


@query(
    "j14_unnest_outer",
    f"WITH a AS ({flat_sql('orders')}) SELECT id, unnest(CASE systems WHEN 0 THEN [NULL] WHEN 1 THEN [1] ELSE [0, 2] END) AS n FROM a",
)
def _(t):
    df = tests(t, "orders").select("id", F.col("client.Network.Systems").alias("systems"))
    return J.unnest(df, "systems", "s", outer=True).select("id", F.when(F.col("s").isNotNull(), F.size("s.ASNs")).alias("n"))


@query(
    "j15_unnest_filter",
    f"WITH a AS ({flat_sql('orders')}) SELECT id, zone FROM a WHERE uuid IS NOT NULL",
)
def _(t):
    df = tests(t, "orders").select("id", F.col("raw.Download.ServerMetadata").alias("meta"))
    return J.unnest(df, "meta", "m").filter("m.Name = 'zone'").select("id", F.col("m.Value").alias("zone"))


@query(
    "j16_lookup",
    f"WITH a AS ({flat_sql('orders')}) SELECT id, CASE WHEN uuid IS NOT NULL THEN client_name END AS client_name FROM a",
)
def _(t):
    name = J.lookup(F.col("raw.Download.ClientMetadata"), "client_name")
    return tests(t, "orders").select("id", name.alias("client_name"))


@query(
    "g15_group_count",
    "SELECT o_orderstatus, count(*) AS n, count(nullif(o_custkey % 3, 0)) AS m FROM orders GROUP BY 1",
)
def _(t):
    third = F.when(F.col("o_custkey") % 3 != 0, 1)
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count(third).alias("m"))


@query("g16_count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def _(t):
    unique = t.orders.select("o_orderpriority", "o_custkey").distinct()
    return unique.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g17_count_if",
    "SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS n FROM lineitem GROUP BY 1",
)
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("n"))


@query(
    "g18_conditional_pivot",
    "SELECT round(sum(CASE WHEN l_returnflag = 'A' THEN l_tax ELSE 0 END), 3) AS a,"
    " round(sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_tax ELSE 0 END) / 30, 3) AS b FROM lineitem",
)
def _(t):
    flag, status, tax = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_tax")
    df = t.lineitem.agg(
        *U.conditional_pivot({"a": (flag == "A", tax, 1.0), "b": ((flag == "N") & (status == "O"), tax, 1 / 30)})
    )
    return df.select(F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))


@query(
    "g19_two_level",
    f"WITH {union_sql('date, parsed')}, d AS (SELECT datatype, date, max(parsed) AS hi, min(parsed) AS lo FROM u GROUP BY 1, 2)"
    " SELECT datatype, count(*) AS dates, CAST(max(epoch(hi)) AS BIGINT) AS hi, CAST(min(epoch(lo)) AS BIGINT) AS lo FROM d GROUP BY 1",
)
def _(t):
    rows = U.tagged_union(three(t), "datatype", ["date", F.col("parser.Time").alias("parsed")])
    dates = rows.groupBy("datatype", "date").agg(F.max("parsed").alias("hi"), F.min("parsed").alias("lo"))
    return dates.groupBy("datatype").agg(
        F.count(F.lit(1)).alias("dates"),
        F.round(F.max(F.unix_micros("hi")) / 1e6).cast("bigint").alias("hi"),
        F.round(F.min(F.unix_micros("lo")) / 1e6).cast("bigint").alias("lo"),
    )


@query(
    "g20_safe_divide",
    "SELECT o_orderstatus, round(sum(o_totalprice) FILTER (o_custkey % 2 = 0) / nullif(count(*) FILTER (o_custkey % 2 = 0 AND o_orderstatus <> 'F'), 0), 4) AS value FROM orders GROUP BY 1",
)
def _(t):
    even = F.col("o_custkey") % 2 == 0
    value = S.safe_divide(
        F.sum(F.when(even, F.col("o_totalprice"))), F.count_if(even & (F.col("o_orderstatus") != "F"))
    )
    return t.orders.groupBy("o_orderstatus").agg(F.round(value, 4).alias("value"))


@query(
    "g21_approx_median",
    "SELECT l_suppkey, quantile_disc(l_extendedprice, 0.5) AS value FROM lineitem GROUP BY 1",
)
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(U.approx_quantile("l_extendedprice", 0.5).alias("value"))


@query(
    "g22_having",
    "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 600 AND l_suppkey IS NOT NULL",
)
def _(t):
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") > 600) & F.col("l_suppkey").isNotNull())


@query("g23_group_as_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def _(t):
    return t.orders.select("o_custkey", "o_orderstatus").dropDuplicates()


@query("g24_global", "SELECT count(*) AS n, max(l_quantity) AS hi FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("hi"))


@query(
    "g25_time_bucket",
    f"SELECT {HOUR_T}, event_type, count(*) AS total FROM events GROUP BY ALL",
)
def _(t):
    return _hour(U.bucket_count(t.ev, "ts", "HOUR", ["event_type"]))


@query(
    "g26_group_by_expression",
    "SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1",
)
def _(t):
    k = (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("k")
    return t.events.groupBy(k).agg(F.count(F.lit(1)).alias("n"))


@query(
    "w1_negative_row_number",
    "WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)"
    " SELECT CAST(d AS VARCHAR) AS date, CAST(-row_number() OVER (ORDER BY d DESC) AS VARCHAR) AS le FROM a",
)
def _(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    return text_date(U.neg_row_number(days, "date"))


@query(
    "w2_running_sum",
    "WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)"
    " SELECT CAST(d AS VARCHAR) AS date, CAST(sum(n) OVER (ORDER BY d) AS BIGINT) AS n FROM a",
)
def _(t):
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return text_date(U.running_sum(days, "n", "date"))


@query(
    "w3_share_of_total",
    "WITH a AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)"
    " SELECT l_returnflag, l_linestatus, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM a",
)
def _(t):
    counts = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    shares = U.share_of(counts, "n", ["l_returnflag"], "share")
    return shares.select("l_returnflag", "l_linestatus", F.round("share", 6).alias("share"))


@query("t1_order_by", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey, n_name")
def _(t):
    return U.order_out(t.nation.select("n_name", "n_regionkey"), "n_regionkey", "n_name")


@query("t2_top_by_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC")
def _(t):
    return U.top_by(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "n", "o_custkey")


@query(
    "t3_limit",
    "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY l_suppkey LIMIT 50",
)
def _(t):
    return U.limit_out(t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), 50, "l_suppkey")


@query("u1_tagged_union", f"WITH {union_sql('id, date')} SELECT datatype, id, CAST(date AS VARCHAR) AS date FROM u")
def _(t):
    return text_date(U.tagged_union(three(t), "datatype", ["id", "date"]))


@query(
    "u2_union_then_aggregate",
    f"WITH {union_sql('date, site')} SELECT datatype, site, count(*) AS n FROM u GROUP BY 1, 2",
)
def _(t):
    rows = U.tagged_union(three(t), "datatype", [F.col("server.Site").alias("site")])
    return rows.groupBy("datatype", "site").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u3_label_values",
    "SELECT DISTINCT regexp_extract(event_type, '^(..).*e.*$', 1) AS value FROM events WHERE regexp_full_match(event_type, '(..).*e.*')",
)
def _(t):
    return U.label_values(t.gauge, "type", P.sel("event_value"), "(..).*e.*")


@query(
    "u5_mixed_sources",
    "SELECT 'A' AS ref, event_type AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'B', o_orderstatus, count(*) FROM orders GROUP BY 2",
)
def _(t):
    a = t.events.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    b = t.orders.groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return U.mixed({"A": a, "B": b}).select("ref", "name", "n")


# --- scalar functions ----------------------------------------------------------------


@query(
    "f1_asof_dates",
    "SELECT o_orderkey, CAST(DATE '2001-06-30' AS VARCHAR) AS today, CAST(DATE '2000-06-30' AS VARCHAR) AS year_before FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        F.lit(S.day_of(ORDERS_ASOF)).cast("string").alias("today"),
        S.year_before(ORDERS_ASOF).cast("string").alias("year_before"),
    )


@query(
    "f2_date_sub",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - 2 AS VARCHAR) AS d, CAST(epoch(o_orderdate - INTERVAL 15 MINUTE) AS BIGINT) AS t FROM orders",
)
def _(t):
    return t.orders.selectExpr(
        "o_orderkey",
        "CAST(date_sub(o_orderdate, 2) AS string) AS d",
        "unix_seconds(CAST(o_orderdate AS timestamp) - INTERVAL 15 MINUTES) AS t",
    )


@query(
    "f3_date_diff",
    "SELECT o_orderkey, DATE '2001-06-30' - CAST(o_orderdate AS DATE) AS days FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey", S.days_between(F.lit(ORDERS_ASOF.date()), F.to_date("o_orderdate")).cast("bigint").alias("days")
    )


@query(
    "f4_whole_units",
    "SELECT event_id, datesub('hour', ts, TIMESTAMP '2024-01-15 12:00:00') AS h, datesub('second', ts, TIMESTAMP '2024-01-15 12:00:00') AS s FROM events",
)
def _(t):
    now = F.lit(datetime(2024, 1, 15, 12)).cast("timestamp")
    return t.ev.select("event_id", S.whole_units("HOUR", now, F.col("ts")).alias("h"), S.whole_units("SECOND", now, F.col("ts")).alias("s"))


@query(
    "f5_trunc",
    f"SELECT event_id, {HOUR_T}, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day FROM events",
)
def _(t):
    return t.ev.select(
        "event_id",
        F.unix_seconds(S.trunc_to("HOUR", F.col("ts"))).alias("time"),
        F.unix_seconds(S.trunc_to("DAY", F.col("ts"))).alias("day"),
    )


@query(
    "f6_casts",
    "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, epoch_us(make_timestamp(event_id * 1000000)) AS us FROM events",
)
def _(t):
    return t.ev.select(
        "event_id",
        F.to_date("ts").cast("string").alias("d"),
        F.unix_micros(F.timestamp_millis(F.col("event_id") * 1000)).alias("us"),
    )


@query("f7_format_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS a, strftime(o_orderdate, '%Y/%m/%d') AS b FROM orders")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", S.fmt_date(d, "yyyyMMdd").alias("a"), S.fmt_date(d, "yyyy/MM/dd").alias("b"))


@query("f8_format_number", "SELECT o_orderkey, CAST(-o_custkey AS VARCHAR) AS s FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.format_string("%d", -F.col("o_custkey")).alias("s"))


@query(
    "f9_regexp_extract",
    r"SELECT page_id, CASE WHEN regexp_matches(url, '://([^/]+)/') THEN regexp_extract(url, '://([^/]+)/', 1) END AS host,"
    r" CASE WHEN regexp_matches(url, '\d+') THEN regexp_extract(url, '\d+') END AS n FROM pages",
)
def _(t):
    url = F.col("url")
    return t.pages.select("page_id", S.rx_extract(url, "://([^/]+)/").alias("host"), S.rx_extract(url, r"\d+").alias("n"))


@query(
    "f10_concat",
    f"WITH a AS ({flat_sql('orders')}) SELECT id, machine || '-' || site AS node FROM a",
)
def _(t):
    return flat(t, "orders").select("id", F.concat("machine", F.lit("-"), "site").alias("node"))


@query("f11_prefix", "SELECT p_partkey, substr(p_type, 1, 3) AS s FROM part")
def _(t):
    return t.part.select("p_partkey", S.prefix(F.col("p_type"), 3).alias("s"))


@query("f12_if", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS s FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 250000, "high").otherwise("low").alias("s"))


@query("f13_array_length", "SELECT vec_id, len(embedding) AS n FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.size("embedding").alias("n"))


@query("f14_to_int64", "SELECT o_orderkey, CAST(round(o_totalprice / 4) AS BIGINT) AS n FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.to_int64(F.col("o_totalprice") / 4).alias("n"))


@query(
    "f15_safe_divide",
    "SELECT o_orderkey, round(o_totalprice / nullif(o_custkey % 3, 0), 6) AS v FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", F.round(S.safe_divide(F.col("o_totalprice"), F.col("o_custkey") % 3), 6).alias("v"))


@query(
    "f16_text_predicates",
    "SELECT page_id, url LIKE '%example%' AS a, starts_with(url, 'https') AS b, regexp_matches(url, '[?]page=[0-9]') AS c FROM pages",
)
def _(t):
    url = F.col("url")
    return t.pages.select(
        "page_id",
        url.like("%example%").alias("a"),
        url.startswith("https").alias("b"),
        url.rlike("[?]page=[0-9]").alias("c"),
    )


@query(
    "d2_node_name",
    r"SELECT page_id, CASE WHEN regexp_matches(url, '//(m)\.') AND regexp_matches(url, '/([a-z]{2})/') THEN regexp_extract(url, '//(m)\.', 1) || '-' || regexp_extract(url, '/([a-z]{2})/', 1) END AS node FROM pages",
)
def _(t):
    return t.pages.select("page_id", S.node_name(F.col("url"), r"//(m)\.", "/([a-z]{2})/").alias("node"))


@query("d1_query_date", "SELECT count(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-26'")
def _(t):
    day = S.query_date(datetime(2024, 1, 28, 12))
    return t.ev.filter(F.to_date("ts") == F.lit(day)).agg(F.count(F.lit(1)).alias("n"))
