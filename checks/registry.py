"""Registry of queries and oracle SQL, and the series derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.model import Grid, label
from tideline.sources.samples import samples_from

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

EVENTS_ASOF = datetime(2024, 1, 28)
ORDERS_ASOF = datetime(2001, 6, 30)
HOURLY = Grid.of(datetime(2024, 1, 1), datetime(2024, 1, 31), "1h")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and its SQL twin."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


class Tables:
    """The driver's tables and the vectors derived from them (whole tables, lazily)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        return self.events.withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def gauge(self) -> DataFrame:
        """``event_value{type, usr}``."""
        return samples_from(
            self.ev, "event_value", {"type": F.col("event_type"), "usr": F.col("user_id")}, "ts", F.col("value")
        )

    @cached_property
    def counter(self) -> DataFrame:
        """``busy_seconds_total{type}``: seconds since midnight, so it resets every day."""
        midnight = F.pmod(F.unix_micros("ts"), F.lit(86_400_000_000))
        return samples_from(
            self.ev, "busy_seconds_total", {"type": F.col("event_type")}, "ts", midnight / 1e6
        )

    @cached_property
    def up(self) -> DataFrame:
        """``up{instance}``: 0 for error events."""
        ok = F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)
        return samples_from(
            self.ev, "up", {"instance": F.col("user_id") % 20, "site": F.col("user_id") % 10}, "ts", ok
        )

    @cached_property
    def maint(self) -> DataFrame:
        """``maint{site}``: 1 for signup events."""
        flag = F.when(F.col("event_type") == "signup", 1.0).otherwise(0.0)
        return samples_from(self.ev, "maint", {"site": F.col("user_id") % 10}, "ts", flag)

    @cached_property
    def buckets(self) -> DataFrame:
        """``price_bucket{flag, le}`` per ship day: cumulative counts of extended prices."""
        bounds = [10000, 25000, 50000, 75000, 100000]
        under = [F.count_if(F.col("l_extendedprice") <= b).alias(f"le{b}") for b in bounds]
        wide = self.lineitem.groupBy("l_shipdate", "l_returnflag").agg(
            *under, F.count(F.lit(1)).alias("all")
        )
        cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le{b}").alias("n")) for b in bounds]
        cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
        counts = wide.select("l_shipdate", "l_returnflag", F.explode(F.array(*cells)).alias("c"))
        counts = counts.select("l_shipdate", "l_returnflag", "c.le", "c.n")
        return samples_from(
            counts, "price_bucket", {"flag": F.col("l_returnflag"), "le": F.col("le")}, "l_shipdate", F.col("n")
        )


def seconds(column: str | Column = "ts") -> Column:
    return F.unix_seconds(F.col(column).cast("timestamp") if isinstance(column, str) else column)


def out(v: DataFrame, *labels: str, digits: int = 6) -> DataFrame:
    """Comparable rows of a vector: label columns, epoch seconds and the rounded value."""
    return v.select(
        *[label(x).alias(x) for x in labels],
        seconds("ts").alias("t"),
        F.round("value", digits).alias("value"),
    )


def special_text(value: Column, scale: int) -> Column:
    """A value as whole thousandths (or the like), with NaN and infinity by name."""
    finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
    return (
        F.when(F.isnan(value), "NaN")
        .when(value == float("inf"), "Inf")
        .otherwise(F.round(finite * scale).cast("bigint").cast("string"))
    )


# --- SQL building blocks -------------------------------------------------------------

LO = HOURLY.start
HOUR = 3_600_000_000
N = HOURLY.last
LO_S = LO // 1_000_000

GAUGE = (
    "s AS (SELECT event_type AS type, CAST(user_id AS VARCHAR) AS usr, epoch_us(ts) AS us, value"
    " FROM events)"
)
COUNTER = (
    "s AS (SELECT event_type AS type, epoch_us(ts) AS us,"
    " CAST(epoch_us(ts) % 86400000000 AS DOUBLE) / 1e6 AS value FROM events)"
)
UP = (
    "s AS (SELECT CAST(user_id % 20 AS VARCHAR) AS instance, CAST(user_id % 10 AS VARCHAR) AS site,"
    " epoch_us(ts) AS us, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value"
    " FROM events)"
)
MAINT = (
    "m AS (SELECT CAST(user_id % 10 AS VARCHAR) AS site, epoch_us(ts) AS us,"
    " CASE WHEN event_type = 'signup' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM events)"
)
BUCKETS = (
    "b AS (SELECT l_returnflag AS flag, CAST(epoch(l_shipdate) AS BIGINT) AS t, le,"
    " CASE le WHEN '+Inf' THEN 'Infinity'::DOUBLE ELSE CAST(le AS DOUBLE) END AS bound,"
    " CAST(count(*) FILTER (le = '+Inf' OR l_extendedprice <= TRY_CAST(le AS DOUBLE)) AS DOUBLE) AS value"
    " FROM lineitem, (SELECT unnest(['10000','25000','50000','75000','100000','+Inf']) AS le)"
    " GROUP BY ALL)"
)


def windowed(d: int, off: int = 0, src: str = "s", name: str = "w", step: int = HOUR) -> str:
    """Each sample once per evaluation ``j`` whose window ``[t - d, t]`` holds it."""
    n = (HOURLY.end - LO) // step
    return (
        f"{name} AS (SELECT *, unnest(generate_series("
        f"greatest(0, CAST(ceil((us + {off} - {LO}) / {step}) AS BIGINT)),"
        f" least({n}, CAST(floor((us + {off} + {d} - {LO}) / {step}) AS BIGINT)))) AS j FROM {src})"
    )


def latest(keys: str, src: str = "w", name: str = "i") -> str:
    return f"{name} AS (SELECT {keys}, j, arg_max(value, us) AS value FROM {src} GROUP BY {keys}, j)"


def instant_cte(base: str, keys: str, d: int = HOUR, off: int = 0) -> str:
    return f"{base}, {windowed(d, off)}, {latest(keys)}"


GRID = f"g AS (SELECT unnest(generate_series(0, {N})) AS j)"
T = f"CAST({LO_S} + j * 3600 AS BIGINT) AS t"


def counter_cte(keys: str, d: int, off: int = 0, step: int = HOUR, name: str = "x") -> str:
    """Extrapolated increase per (keys, j) as CTE ``x`` with columns raw and value."""
    end = f"({LO} + j * {step} - {off})"
    return (
        f"{windowed(d, off, step=step)},"
        f" c AS (SELECT {keys}, j, us, value, lag(value) OVER (PARTITION BY {keys}, j ORDER BY us) AS pv FROM w),"
        f" a AS (SELECT {keys}, j, count(*) AS n, min(us) AS u0, max(us) AS u1, arg_min(value, us) AS v0,"
        f" arg_max(value, us) AS v1, sum(CASE WHEN value < pv THEN pv ELSE 0 END) AS lost,"
        f" count(*) FILTER (value < pv) AS resets FROM c GROUP BY {keys}, j),"
        f" p AS (SELECT {keys}, j, v0, v1 - v0 + lost AS raw, (u1 - u0) / 1e6 AS cov,"
        f" (u1 - u0) / 1e6 / (n - 1) AS gap, (u0 - ({end} - {d})) / 1e6 AS ds, ({end} - u1) / 1e6 AS de"
        f" FROM a WHERE n > 1),"
        f" q AS (SELECT *, CASE WHEN ds >= gap * 1.1 THEN gap / 2 ELSE ds END AS rs,"
        f" CASE WHEN de >= gap * 1.1 THEN gap / 2 ELSE de END AS re FROM p),"
        f" {name} AS (SELECT {keys}, j, raw, raw * ((cov + CASE WHEN raw > 0 AND v0 >= 0"
        f" THEN least(rs, cov * (v0 / raw)) ELSE rs END + re) / cov) AS value FROM q)"
    )
