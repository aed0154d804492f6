"""Measurement, billing and log tables derived from the driver's tables (whole tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INVALID = "INVALID_ID"

# Expressions valid in both engines over (k, c, ts, price).
FLAT = {
    "id": "CAST(k AS {text})",
    "lat": "CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(c % 90 AS DOUBLE) END",
    "lon": "CAST(c % 180 AS DOUBLE)",
    "country": "concat('C', c % 5)",
    "s_country": "concat('C', k % 5)",
    "site": "CASE WHEN k % 101 = 0 THEN NULL ELSE concat(CASE c % 3 WHEN 0 THEN 'lga' WHEN 1 THEN 'ams' ELSE 'nrt' END, '0', c % 2 + 1) END",
    "machine": "concat('mach', c % 4 + 1)",
    "url": "concat('store://org', c % 3, '/', k % 37)",
    "systems": "k % 3",
    "uuid": "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '" + INVALID + "' ELSE concat('u', k) END",
    "rate": "price / 100",
    "client_name": "CASE WHEN k % 4 = 0 THEN NULL ELSE concat('client', k % 3) END",
    "machine_type": "CASE WHEN k % 5 = 0 THEN 'virtual' ELSE 'physical' END",
    "zone": "concat('z', c % 3)",
}

SOURCES = {
    "lines": ("lineitem", "l_orderkey * 10 + l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice"),
    "orders": ("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"),
    "events": ("events", "event_id", "user_id", "ts", "value"),
}


def flat_sql(name: str) -> str:
    """CTE body with the derived columns, for DuckDB."""
    table, k, c, ts, price = SOURCES[name]
    columns = ", ".join(f"{sql.format(text='VARCHAR')} AS {col}" for col, sql in FLAT.items())
    return (
        f"SELECT {columns}, k, ts, CAST(ts AS DATE) AS date, ts + to_hours(CAST(k % 50 AS INTEGER)) AS parsed,"
        f" ts + to_hours(CAST(k % 48 AS INTEGER)) AS ended FROM"
        f" (SELECT {k} AS k, {c} AS c, {ts} AS ts, {price} AS price FROM {table})"
    )


def flat(t, name: str) -> DataFrame:
    table, k, c, ts, price = SOURCES[name]
    base = getattr(t, table).selectExpr(
        f"{k} AS k", f"{c} AS c", f"CAST({ts} AS timestamp) AS ts", f"{price} AS price"
    )
    return base.selectExpr(
        *[f"{sql.format(text='STRING')} AS {col}" for col, sql in FLAT.items()],
        "k",
        "ts",
        "CAST(ts AS date) AS date",
        "ts + make_interval(0, 0, 0, 0, CAST(k % 50 AS int)) AS parsed",
        "ts + make_interval(0, 0, 0, 0, CAST(k % 48 AS int)) AS ended",
    )


def tests(t, name: str) -> DataFrame:
    """The nested shape of a measurement table."""
    return flat(t, name).selectExpr(
        "date",
        "id",
        "named_struct('Time', parsed, 'ArchiveURL', url) AS parser",
        "named_struct('ArchiveURL', url) AS archiver",
        "named_struct('Geo', named_struct('Latitude', lat, 'Longitude', lon, 'CountryCode', country),"
        " 'Network', named_struct('Systems', CASE systems WHEN 0 THEN CAST(array() AS array<struct<ASNs:array<int>>>)"
        " WHEN 1 THEN array(named_struct('ASNs', array(1)))"
        " ELSE array(named_struct('ASNs', CAST(array() AS array<int>)), named_struct('ASNs', array(1, 2))) END)) AS client",
        "named_struct('Site', site, 'Machine', machine, 'Geo', named_struct('Latitude', lon, 'Longitude', lon,"
        " 'CountryCode', s_country)) AS server",
        "named_struct('StartTime', ts, 'Download', CASE WHEN uuid IS NOT NULL THEN named_struct('UUID', uuid,"
        " 'StartTime', ts, 'EndTime', ended,"
        " 'ClientMetadata', CASE WHEN client_name IS NULL THEN array(named_struct('Name', 'os', 'Value', 'x'))"
        " ELSE array(named_struct('Name', 'os', 'Value', 'x'), named_struct('Name', 'client_name', 'Value', client_name)) END,"
        " 'ServerMetadata', array(named_struct('Name', 'type', 'Value', machine_type), named_struct('Name', 'zone', 'Value', zone))"
        ") END) AS raw",
        "named_struct('MeanThroughputMbps', rate, 'TestTime', ts) AS a",
    )


def bills(t) -> DataFrame:
    """Billing export: one row per line item."""
    parts = t.part.select("p_partkey", "p_type", "p_brand")
    return t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "CAST(l_shipdate AS timestamp) AS usage_start_time",
        "named_struct('description', p_type) AS service",
        "named_struct('description', p_brand) AS sku",
        "named_struct('id', CASE WHEN l_linenumber = 7 THEN NULL ELSE 'main' END) AS project",
        "l_extendedprice AS cost",
    )


BILLS = (
    "bills AS (SELECT l_shipdate AS ts, p_type AS service, p_brand AS sku,"
    " CASE WHEN l_linenumber = 7 THEN NULL ELSE 'main' END AS project, l_extendedprice AS cost"
    " FROM lineitem JOIN part ON l_partkey = p_partkey)"
)


def audit(t) -> DataFrame:
    """Audit log: one row per event."""
    return t.ev.selectExpr(
        "ts AS timestamp",
        "named_struct('audit_log', named_struct("
        "'authentication_info', named_struct('principal_email', CASE WHEN event_id % 17 = 0 THEN NULL"
        " ELSE concat('user', user_id, CASE WHEN user_id % 4 = 0 THEN '@robots.example' ELSE '@people.example' END) END),"
        " 'method_name', CASE WHEN event_type = 'error' THEN 'query.run' ELSE concat('storage.', event_type, '.get') END,"
        " 'service_name', event_type,"
        " 'resource_name', CASE WHEN event_id % 5 = 0 THEN 'bucket/none' ELSE"
        " concat('bucket/', date_format(date_sub(CAST(ts AS date), CAST(user_id % 9 AS int)), 'yyyy/MM/dd'), '/f') END)) AS proto_payload",
    )


AUDIT = (
    "audit AS (SELECT ts, CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('user', user_id, CASE WHEN user_id % 4 = 0"
    " THEN '@robots.example' ELSE '@people.example' END) END AS usr,"
    " CASE WHEN event_type = 'error' THEN 'query.run' ELSE concat('storage.', event_type, '.get') END AS action,"
    " event_type AS service, CASE WHEN event_id % 5 = 0 THEN 'bucket/none' ELSE concat('bucket/',"
    " strftime(CAST(ts AS DATE) - CAST(user_id % 9 AS INTEGER), '%Y/%m/%d'), '/f') END AS resource FROM events)"
)


def request_log(t) -> DataFrame:
    """Request log in daily shards: one request per turn, with its lines as an array."""
    start = F.expr("timestamp'2024-01-28 00:05:00' - make_interval(0, 0, 0, 0, 0, CAST(conv_id % 40 AS int))")
    line = F.struct(F.concat("role", F.lit(": "), "text").alias("logMessage"))
    return t.conversations.select(
        start.alias("starttime"), F.date_format(start, "yyyyMMdd").alias("table_suffix"), F.array(line).alias("line")
    )
