"""Warehouse reports as parameterised jobs over measurement, billing and log tables.

Every report takes its tables as DataFrames and its time as ``asof``; nothing is read
from the clock and no text is spliced into SQL.  Date limits are literals, so a table
partitioned by ``date`` is pruned.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import (
    day_of,
    days_between,
    fmt_date,
    prefix,
    query_date,
    rx_extract,
    safe_divide,
    to_int64,
    whole_units,
    year_before,
)
from tideline.operators.joins import (
    coverage,
    flag_in,
    interval_touch_semi,
    lookup,
    unnest,
    zero_fill,
)
from tideline.operators.panels import distribution, median_map
from tideline.operators.select import (
    choose,
    date_window,
    lag_slice,
    maybe,
    period_of,
    same_field,
    time_range,
)
from tideline.operators.tables import (
    bucket_count,
    conditional_pivot,
    limit_out,
    neg_row_number,
    order_out,
    running_sum,
    share_of,
    tagged_union,
    top_by,
)
from tideline.sources.warehouse import scan_shards

REPORTS: dict[str, Callable[..., DataFrame]] = {}


def report(name: str):
    def register(fn):
        REPORTS[name] = fn
        return fn

    return register


def run_report(name: str, **params) -> DataFrame:
    return REPORTS[name](**params)


def _on(df: DataFrame, day: date) -> DataFrame:
    return df.filter(F.col("date") == F.lit(day))


@report("annotation_coverage")
def annotation_coverage(tables: dict[str, DataFrame], asof: datetime) -> DataFrame:
    """Rows with a location and with network numbers two days ago.

    The outer unnest repeats a test per network system; totals count those pairs.
    """
    keep = [
        F.col("client.Geo.Latitude").alias("lat"),
        F.col("client.Geo.Longitude").alias("lon"),
        F.col("client.Network.Systems").alias("systems"),
        "date",
    ]
    rows = _on(tagged_union(tables, "datatype", keep), day_of(asof) - timedelta(days=2))
    rows = unnest(rows, "systems", "system", outer=True)
    asns = F.col("system.ASNs")
    return rows.groupBy("datatype").agg(
        F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("value_geo_success"),
        F.count_if(asns.isNotNull() & (F.size(asns) != 0)).alias("value_asn_success"),
        F.count(F.lit(1)).alias("value_total"),
    )


@report("billing")
def billing(bills: DataFrame, asof: datetime, services: dict[str, str]) -> DataFrame:
    """Cost by period and service in one row; ``services`` maps suffix to description.

    The month bucket holds what the other periods left and is divided by 30.
    """
    day = day_of(asof)
    cost = bills.withColumn("day", F.to_date("usage_start_time"))
    cost = date_window(cost, "day", day, 31).filter(
        F.col("project.id").isNotNull() & F.col("cost").isNotNull()
    )
    rows = cost.select(
        period_of(F.col("usage_start_time"), day).alias("period"),
        F.col("service.description").alias("service"),
        "cost",
    )
    spent, period = F.col("cost"), F.col("period")
    month = period == "month"
    sums = {
        "value_average_daily": (month, spent, 1 / 30),
        "value_average_monthly": (month, spent, 1.0),
        "value_average_annual": (month, spent, 365 / 30),
    }
    for suffix, description in services.items():
        here = F.col("service") == description
        sums[f"value_average_daily_{suffix}"] = (month & here, spent, 1 / 30)
        for name in ("today", "yesterday", "before_yesterday"):
            sums[f"value_{name}_{suffix}"] = ((period == name) & here, spent, 1.0)
    return rows.agg(*conditional_pivot(sums))


@report("daily_archives")
def daily_archives(tables: dict[str, DataFrame], asof: datetime) -> DataFrame:
    """Distinct archives parsed per datatype two days ago."""
    keep = ["date", F.col("parser.ArchiveURL").alias("url")]
    rows = _on(tagged_union(tables, "datatype", keep), day_of(asof) - timedelta(days=2))
    # distinct first: a large datatype is spread over its archives
    unique = rows.filter(F.col("url").isNotNull()).select("datatype", "url").distinct()
    return unique.groupBy("datatype").agg(F.count(F.lit(1)).alias("value_count"))


@report("access_counts")
def access_counts(tables: dict[str, DataFrame], asof: datetime) -> DataFrame:
    """Rows a user can read per datatype two days ago."""
    rows = _on(tagged_union(tables, "datatype", ["date"]), day_of(asof) - timedelta(days=2))
    return rows.groupBy("datatype").agg(F.count(F.lit(1)).alias("value_total"))


@report("cumulative_tests")
def cumulative_tests(first: DataFrame, second: DataFrame, asof: datetime) -> DataFrame:
    """Running count of 180 days of tests; ``le`` numbers the days from the newest (-1).

    A date missing from one table drops out.
    """
    oldest = F.lit(day_of(asof) - timedelta(days=180))

    def daily(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("date") > oldest).groupBy("date").agg(F.count(F.lit(1)).alias(name))

    both = daily(first, "a").join(daily(second, "b"), "date")
    counts = both.select("date", (F.col("a") + F.col("b")).alias("n"))
    numbered = neg_row_number(counts, "date")
    return running_sum(numbered, "n", "date", "value_count").select("le", "value_count")


@report("parse_freshness")
def parse_freshness(tables: dict[str, DataFrame], asof: datetime) -> DataFrame:
    """Freshness of parsed dates per datatype over a year."""
    keep = ["id", "date", F.col("parser.Time").alias("parsed")]
    rows = tagged_union(tables, "datatype", keep).filter(F.col("date") > year_before(asof))
    today, now = F.lit(day_of(asof)), F.lit(asof)
    dates = rows.groupBy("datatype", "date").agg(
        F.count("id").alias("n"),
        whole_units("HOUR", now, F.max("parsed")).alias("age"),
        (whole_units("HOUR", F.max("parsed"), F.min("parsed")) > 24).alias("stale"),
    )
    last4 = days_between(today, F.col("date")) <= 4
    last30 = days_between(today, F.col("date")) <= 30

    def rows_per_date(recent: Column) -> Column:
        return to_int64(safe_divide(F.sum(F.when(recent, F.col("n")).otherwise(0)), F.count_if(recent)))

    ages = {"day": 24, "7_days": 7 * 24, "30_days": 30 * 24, "90_days": 90 * 24}
    stale, age = F.col("stale"), F.col("age")
    return dates.groupBy("datatype").agg(
        F.count("date").alias("value_total_dates"),
        rows_per_date(last4).alias("value_rows_per_date_last_4_dates"),
        rows_per_date(last30).alias("value_rows_per_date_last_30_dates"),
        F.count_if((age < 4 * 24) & last4).alias("value_daily_done_last_4_days"),
        F.count_if(stale).alias("value_dates_partially_parsed"),
        *[
            F.count_if(stale & (age < h)).alias(f"value_dates_partially_parsed_last_{n}")
            for n, h in ages.items()
        ],
        *[
            F.count_if(~stale & (age < h)).alias(f"value_dates_fully_parsed_last_{n}")
            for n, h in ages.items()
        ],
    )


@report("historical_throughput")
def historical_throughput(tables: dict[tuple[str, str], DataFrame], asof: datetime) -> DataFrame:
    """Past dates processed within 24 hours per type; types without any get 0."""
    named = {f"{e}/{d}": df for (e, d), df in tables.items()}
    rows = tagged_union(named, "type", ["date", F.col("parser.Time").alias("parsed")])
    rows = rows.filter(F.col("date") > year_before(asof))
    now = F.lit(asof)
    recent = F.col("parsed").between(F.lit(asof - timedelta(hours=24)), now)
    past = F.col("date") < F.date_sub(F.to_date("parsed"), 1)
    done = rows.filter(recent & past).select("type", "date").distinct()
    done = done.groupBy("type").agg(F.count(F.lit(1)).alias("value_throughput"))
    filled = zero_fill(rows, done, ["type"], "value_throughput")
    parts = F.split("type", "/")
    return filled.select(
        parts[0].alias("experiment"), parts[1].alias("datatype"), "value_throughput"
    )


@report("parse_age")
def parse_age(tables: dict[str, DataFrame], asof: datetime) -> DataFrame:
    """Age in days of the oldest parse per datatype."""
    keep = ["date", F.col("parser.Time").alias("parsed")]
    rows = tagged_union(tables, "datatype", keep).filter(F.col("date") > year_before(asof))
    oldest = rows.groupBy("datatype").agg(F.min("parsed").alias("oldest"))
    age = whole_units("SECOND", F.lit(asof), F.col("oldest")) / 86400.0
    return oldest.select("datatype", age.alias("value_age_days"))


@report("rate_limit_hits")
def rate_limit_hits(log: DataFrame, asof: datetime, signature: str) -> DataFrame:
    """Log lines that start with the signature in a 5 minute slice 10 minutes ago."""
    today = day_of(asof)
    rows = scan_shards(log, [today, today - timedelta(days=1)])
    rows = lag_slice(rows, "starttime", asof, timedelta(minutes=15), timedelta(minutes=10))
    lines = rows.select(F.explode("line.logMessage").alias("message"))
    return lines.filter(F.col("message").startswith(signature)).agg(
        F.count(F.lit(1)).alias("value")
    )


@report("tests_with_discards")
def tests_with_discards(
    tests: dict[str, DataFrame], switch: DataFrame, asof: datetime, poll: timedelta, invalid: str, metro: str
) -> DataFrame:
    """Tests whose start or end fell into a switch poll with discards, per site and node.

    ``metro`` is a regex whose first group takes the metro from a site.

    ``tests``: (date, uuid, tstart, tend, machine, site); ``switch``: (date, machine,
    site, collected, discards).
    """
    day = query_date(asof)
    node = F.concat("machine", F.lit("-"), "site").alias("node")
    polls = (
        _on(switch, day)
        .filter(F.col("discards") > 0)
        .select(node, (F.col("collected") - F.lit(poll)).alias("tstart"), F.col("collected").alias("tend"))
        .distinct()
    )
    keep = ["date", "uuid", "tstart", "tend", "machine", "site"]
    rows = _on(tagged_union(tests, "source", keep), day)
    rows = rows.filter(F.col("uuid").isNotNull() & (F.col("uuid") != invalid))
    ends = rows.select(node, "uuid", "tstart", "tend").distinct()
    touched = interval_touch_semi(ends, polls, poll).select("uuid")
    # counted before the join, so a repeated id travels as one row
    counts = rows.groupBy("uuid", "site", node).agg(F.count(F.lit(1)).alias("n"))
    flagged = flag_in(counts, touched, "uuid", "discards")
    named = rx_extract(F.col("site"), metro).alias("metro")
    hit = F.when(F.col("discards") == "true", F.col("n")).otherwise(0)
    out = flagged.groupBy(named, "site", "node").agg(
        F.sum(hit).alias("value_with_discards"), F.sum("n").alias("value_total")
    )
    return order_out(out, "metro", "site", "node")


@report("sidecar_coverage")
def sidecar_coverage(
    tests: DataFrame, traces: DataFrame, asof: datetime, more_than: int = 1000
) -> DataFrame:
    """Tests per site and how many have a trace with the same id, two days ago."""
    day = day_of(asof) - timedelta(days=2)
    left = _on(tests, day).select("id", F.col("server.Site").alias("site"))
    out = coverage(left, _on(traces, day).select("id"), "id", "site")
    return out.filter((F.col("value_total") > more_than) & F.col("site").isNotNull())


@report("recent_rows")
def recent_rows(tests: DataFrame, asof: datetime) -> DataFrame:
    """Rows that started in the last 24 hours; the date limit prunes partitions."""
    start = F.col("raw.StartTime")
    near = tests.filter(F.col("date") > F.lit(day_of(asof) - timedelta(days=2)))
    return near.filter(start > F.lit(asof - timedelta(hours=24))).agg(
        F.count(F.lit(1)).alias("value_total")
    )


@report("hourly_by_site")
def hourly_by_site(
    tables: dict[str, DataFrame], first: date, last: date, site_regex: str
) -> DataFrame:
    """Tests per hour and site over several stores (sites found anywhere by the regex)."""
    keep = ["date", F.col("raw.StartTime").alias("start"), F.col("server.Site").alias("metric")]
    rows = tagged_union(tables, "store", keep)
    rows = rows.filter(F.col("date").between(F.lit(first), F.lit(last)))
    rows = rows.filter(F.col("metric").isNotNull() & F.col("metric").rlike(site_regex))
    return order_out(bucket_count(rows, "start", "HOUR", ["metric"]), "time", "metric")


@report("metros")
def metros(core: DataFrame, hosted: DataFrame, asof: datetime, org: str, core_org: str):
    """Three-letter prefixes of sites seen since yesterday; a prefix repeats per site."""
    site = F.col("server.Site").alias("site")

    def sites(df: DataFrame, wanted: Column) -> DataFrame:
        near = date_window(df, "date", day_of(asof), 1).filter(wanted)
        return near.select(site).filter(F.col("site").isNotNull()).distinct()

    own = sites(core, F.lit(org == core_org))
    others = sites(hosted, F.col("archiver.ArchiveURL").like(f"%{org}%"))
    both = own.unionByName(others)
    return order_out(both.select(prefix(F.col("site"), 3).alias("metro")), "metro")


@report("client_names")
def client_names(tests: DataFrame, first: date, last: date, more_than: int = 10) -> DataFrame:
    """Tests per day and client name."""
    rows = tests.filter(F.col("date").between(F.lit(first), F.lit(last)))
    rows = rows.filter(F.col("raw.Download").isNotNull())
    name = lookup(F.col("raw.Download.ClientMetadata"), "client_name")
    named = rows.select("date", F.coalesce(name, F.lit("UNNAMED")).alias("metric"))
    out = named.groupBy("date", "metric").agg(F.count(F.lit(1)).alias("total"))
    return order_out(out.filter(F.col("total") > more_than), "date", "metric")


def _server_metadata(tests: DataFrame, first: date, last: date, name: str) -> DataFrame:
    rows = tests.filter(F.col("date").between(F.lit(first), F.lit(last)))
    rows = rows.filter(F.col("server.Site").isNotNull() & F.col("raw.Download").isNotNull())
    pairs = rows.select(
        "date",
        F.col("server.Site").alias("site"),
        F.explode("raw.Download.ServerMetadata").alias("m"),
    )
    return pairs.filter(F.col("m.Name") == name)


@report("machine_types")
def machine_types(tests: DataFrame, first: date, last: date) -> DataFrame:
    """Share of each machine type per day."""
    rows = _server_metadata(tests, first, last, "type")
    counts = rows.groupBy("date", F.col("m.Value").alias("metric")).agg(
        F.count(F.lit(1)).alias("total")
    )
    shares = share_of(counts, "total", ["date"], "ratio")
    return order_out(shares.select("date", "metric", "ratio"), "date", "metric")


@report("site_zones")
def site_zones(tests: DataFrame, first: date, last: date) -> DataFrame:
    """Tests per day and site zone."""
    rows = _server_metadata(tests, first, last, "zone")
    zone = F.concat("site", F.lit("-"), F.col("m.Value")).alias("metric")
    out = rows.groupBy("date", zone).agg(F.count(F.lit(1)).alias("total"))
    return order_out(out, "date", "metric")


@report("same_country")
def same_country(tests: DataFrame, first: date, last: date) -> DataFrame:
    """Tests per day whose client and server are in one country."""
    rows = tests.filter(F.col("date").between(F.lit(first), F.lit(last)))
    country = F.col("client.Geo.CountryCode")
    same = same_field(
        country,
        F.col("server.Geo.CountryCode"),
        F.col("server.Geo.Longitude"),
        F.col("server.Geo.Latitude"),
        F.col("client.Geo.Longitude"),
        F.col("client.Geo.Latitude"),
        F.col("raw.Download"),
    )
    out = rows.filter(same).groupBy("date", country.alias("metric"))
    return order_out(out.agg(F.count(F.lit(1)).alias("total")), "date", "metric")


@report("rate_map")
def rate_map(tests: DataFrame, first: date, last: date, more_than: int = 10, limit: int = 2500):
    """Median rate per location."""
    rows = tests.filter(F.col("date").between(F.lit(first), F.lit(last)))
    rows = rows.filter(F.col("raw.Download").isNotNull()).select(
        F.col("a.MeanThroughputMbps").alias("rate"),
        F.col("client.Geo.Latitude").alias("latitude"),
        F.col("client.Geo.Longitude").alias("longitude"),
    )
    medians = median_map(rows, "rate", ["latitude", "longitude"], more_than)
    out = medians.select("latitude", "longitude", "value")
    return limit_out(out, limit, "latitude", "longitude")


def _audit(log: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    audit = "proto_payload.audit_log"
    rows = time_range(log, "timestamp", from_ms, to_ms).select(
        "timestamp",
        F.col(f"{audit}.authentication_info.principal_email").alias("user"),
        F.col(f"{audit}.method_name").alias("action"),
        F.col(f"{audit}.service_name").alias("service"),
        F.col(f"{audit}.resource_name").alias("resource"),
    )
    return rows.filter(F.col("user").isNotNull())


@report("queries_per_user_hour")
def queries_per_user_hour(log: DataFrame, from_ms: int, to_ms: int, service: str) -> DataFrame:
    rows = _audit(log, from_ms, to_ms).filter(F.col("service") == service)
    return order_out(bucket_count(rows, "timestamp", "HOUR", ["user"]), "time", "user")


def storage_rows(
    log: DataFrame, from_ms: int, to_ms: int, asof: datetime, method: str, robots: str, days: int, dated: str
) -> DataFrame:
    """Storage operations of people; with ``days`` only on objects dated that long ago.

    ``dated`` is a regex for the date in an object's name, compared as ``yyyy/MM/dd`` text.
    """
    rows = _audit(log, from_ms, to_ms)
    rows = rows.filter(F.col("action").like(method) & ~F.col("user").like(robots))
    day = rx_extract(F.col("resource"), dated, 0)
    limit = fmt_date(F.lit(day_of(asof) - timedelta(days=days)), "yyyy/MM/dd")
    return rows.filter(maybe(days, day <= limit))


@report("storage_per_user_hour")
def storage_per_user_hour(**params) -> DataFrame:
    return order_out(
        bucket_count(storage_rows(**params), "timestamp", "HOUR", ["user"]), "time", "user"
    )


@report("storage_per_user")
def storage_per_user(**params) -> DataFrame:
    out = storage_rows(**params).groupBy("user").agg(F.count(F.lit(1)).alias("total"))
    return top_by(out, "total", "user")


@report("storage_per_action_hour")
def storage_per_action_hour(**params) -> DataFrame:
    rows = storage_rows(**params)
    return order_out(
        bucket_count(rows, "timestamp", "HOUR", ["user", "action"]), "time", "user", "action"
    )


@report("storage_listing")
def storage_listing(**params) -> DataFrame:
    return storage_rows(**params)


@report("storage_cost")
def storage_cost(bills: DataFrame, from_ms: int, to_ms: int, service: str) -> DataFrame:
    """Cost per hour and product of the services that fit a pattern."""
    rows = time_range(bills, "usage_start_time", from_ms, to_ms)
    rows = rows.filter(F.col("service.description").like(service))
    out = rows.groupBy(
        F.date_trunc("HOUR", "usage_start_time").alias("time"),
        F.col("sku.description").alias("sku"),
    ).agg(F.sum("cost").alias("cost"))
    return order_out(out, "time", "sku")


@report("performance_distribution")
def performance_distribution(
    tables: dict[str, DataFrame],
    low: float,
    high: float,
    metric: str,
    first: date,
    last: date,
    site_regex: str,
    mode: str = "pdf",
    bins: int = 50,
    mask: Column | None = None,
) -> DataFrame:
    """PDF or CDF of a measure per site, for one or several stores."""
    parts = {}
    for name, df in tables.items():
        rows = df.filter(F.col("date").between(F.lit(first), F.lit(last)))
        rows = rows.filter(F.col("site").rlike(site_regex))
        frame = distribution(rows, low, high, metric, "site", bins, mask)
        data = choose(mode, F.col("site_pdf"), F.col("site_cdf"))
        parts[name] = frame.select("xright", data.alias("data"), "site")
    return order_out(tagged_union(parts, "store"), "xright", "site")


@report("hourly_tests")
def hourly_tests(tests: DataFrame, from_ms: int, to_ms: int, site_regex: str) -> DataFrame:
    """Tests per hour and site in the panel's time range."""
    rows = time_range(tests, "TestTime", from_ms, to_ms)
    rows = rows.filter(F.col("site").rlike(site_regex))
    out = bucket_count(rows, "TestTime", "HOUR", [F.col("site").alias("metric")])
    return order_out(out, "time", "metric")
