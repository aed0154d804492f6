"""Streaming jobs replayed over the whole event table, with twins of their batch results.

A stream returns what its watermark has passed: evaluations up to the newest event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import COUNTER, GAUGE, HOUR, HOURLY, LO, Tables, counter_cte, instant_cte, label, query, seconds
from tideline.model import labels_of
from tideline.operators.select import eq, sel
from tideline.shared import fresh_path
from tideline.streaming.alerts import stream_alerts
from tideline.streaming.instants import GaugeRule, absent_instances, stream_absent, stream_gauge_rules, stream_instants
from tideline.streaming.recorded import stream_recorded

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StreamTables(Tables):
    """The same tables as streams."""

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.dir}/{name}.parquet"
        # A table may be one file.  Streams read folders or patterns, so it is named by a pattern.
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def replay(t: Tables, make: Callable[[StreamTables], DataFrame]) -> DataFrame:
    """Rows that a streaming job has returned when its input is read."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows, path = make(StreamTables(t.spark, t.dir)), fresh_path(t.spark, "replay")
    job = rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/job")
    job.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{path}/rows")


@query(
    "s2_stream_samples",
    f"WITH {GAUGE} SELECT type, usr, us, count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY type, usr, us",
)
def _(t):
    """Samples of a stream, with their canonical keys."""
    rows = replay(t, lambda s: s.gauge.select("metric", "series_id", "ts", "value"))
    named = rows.filter("metric = 'event_value'").withColumn("labels", labels_of("series_id"))
    return named.groupBy(label("type").alias("type"), label("usr").alias("usr"), F.unix_micros("ts").alias("us")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value")
    )


PASSED = "passed AS (SELECT CAST(floor(max(us) / 1000) * 1000 AS BIGINT) AS wm FROM s)"
T = f"CAST({LO // 1_000_000} + j * 3600 AS BIGINT) AS t"


@query(
    "s2_stream_instants",
    f"WITH {instant_cte(GAUGE, 'type, usr', 2 * HOUR)}, {PASSED}"
    f" SELECT type, usr, {T}, round(value, 6) AS value FROM i, passed WHERE {LO} + j * {HOUR} <= wm",
)
def _(t):
    """Latest samples within two hours, hourly, from one state per series."""
    rows = replay(t, lambda s: stream_instants(s.gauge, HOURLY.start / 1e6, "1h", "2h"))
    return rows.select(label("type").alias("type"), label("usr").alias("usr"), seconds("ts").alias("t"), F.round("value", 6).alias("value"))


@query(
    "x14_stream_recorded",
    f"WITH {COUNTER}, {counter_cte('type', 24 * HOUR, step=HOUR // 4)}, {PASSED}"
    f" SELECT type, CAST(({LO} + j * {HOUR // 4}) // 1000000 AS BIGINT) AS t, round(value, 4) AS value FROM x, passed"
    f" WHERE {LO} + j * {HOUR // 4} <= wm",
)
def _(t):
    """``sum by (type) (increase(counter[24h]))`` every 15 minutes, from one state per slice."""
    rows = replay(t, lambda s: stream_recorded(s.counter, "24h", "15m", ["type"]))
    return rows.select("type", seconds("ts").alias("t"), F.round("value", 4).alias("value"))


EVENTS = (
    " r AS (SELECT *, j - row_number() OVER (PARTITION BY {keys} ORDER BY j) AS run FROM act),"
    " runs AS (SELECT {keys}, min(j) AS since, max(j) AS last FROM r GROUP BY {keys}, run),"
    " ev AS (SELECT {keys}, 'pending' AS event, since AS j FROM runs"
    " UNION ALL SELECT {keys}, 'firing', since + {hold} FROM runs WHERE last >= since + {hold}"
    f" UNION ALL SELECT {{keys}}, 'resolved', last + 1 FROM runs, passed WHERE last >= since + {{hold}} AND {LO} + (last + 1) * {HOUR} < wm)"
)


@query(
    "x3_stream_gauge_alerts",
    f"WITH {instant_cte(GAUGE, 'type, usr', 2 * HOUR)}, {PASSED},"
    f" act AS (SELECT 'Low' AS alert, type, usr, j FROM i, passed WHERE value < 30 AND {LO} + j * {HOUR} <= wm"
    f" UNION ALL SELECT 'Odd', type, usr, j FROM i, passed WHERE type = 'click' AND value > 10 AND {LO} + j * {HOUR} <= wm),"
    f"{EVENTS.format(keys='alert, type, usr', hold=1)} SELECT alert, type, usr, event, {T} FROM ev",
)
def _(t):
    """From streamed samples to pending, firing and resolved events of a rule set, held for an hour."""
    value = sel("event_value")
    rules = [GaugeRule("Low", value, "<", 30), GaugeRule("Odd", sel("event_value", eq("type", "click")), ">", 10)]

    def job(s):
        return stream_alerts(stream_gauge_rules(rules, s.gauge, HOURLY.start / 1e6, "1h", "2h"), "1h", "1h")

    rows = replay(t, job).withColumn("labels", labels_of("series_id"))
    return rows.select("alert", label("type").alias("type"), label("usr").alias("usr"), "event", seconds("at").alias("t"))


@query(
    "x3_stream_absent_alerts",
    f"WITH {GAUGE}, g AS (SELECT unnest(generate_series(0, {HOURLY.last})) AS j), {PASSED.replace('max(us)', '(max(us) - 1)')},"
    f" seen AS (SELECT DISTINCT unnest(generate_series(greatest(0, CAST(ceil((us - {LO}) / {HOUR}) AS BIGINT)),"
    f" least({HOURLY.last}, CAST(floor((us + {HOUR} - {LO}) / {HOUR}) AS BIGINT)))) AS j FROM s WHERE usr = '7'),"
    f" act AS (SELECT 'Silent' AS alert, j FROM g, passed WHERE {LO} + j * {HOUR} <= wm AND j NOT IN (SELECT j FROM seen)),"
    f"{EVENTS.format(keys='alert', hold=2)} SELECT alert, event, {T} FROM ev",
)
def _(t):
    """No sample of one user for two hours, told by the clock of all samples."""

    def job(s):
        silent = stream_absent(s.gauge, sel("event_value", eq("usr", "7")), HOURLY.start / 1e6, "1h", "1h")
        return stream_alerts(absent_instances("Silent", silent), "2h", "1h")

    return replay(t, job).select("alert", "event", seconds("at").alias("t"))
