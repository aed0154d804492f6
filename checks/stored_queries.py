"""Samples and report partials that are stored first and then read as stored."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import COUNTER, HOUR, HOURLY, T, counter_cte, out, query
from tideline.operators import rangefn as R
from tideline.plans.incremental import PartialReport, averaged, counted, highest, lowest, median_map, quantile, summed
from tideline.shared import fresh_path
from tideline.sources.samples import bucketed_samples, write_bucketed


def _bucketed(t, v):
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"samples_{uuid.uuid4().hex}"
    write_bucketed(v, name, fresh_path(t.spark, "samples"), buckets)
    return bucketed_samples(t.spark, name)


@query(
    "r4_increase_bucketed",
    f"WITH {COUNTER}, {counter_cte('type', 6 * HOUR)} SELECT type, {T}, round(value, 4) AS value FROM x",
)
def _(t):
    """From samples stored by series and day, which are folded without a shuffle of samples."""
    return out(R.increase(_bucketed(t, t.counter), "6h", HOURLY), "type", digits=4)


def _refreshed(t, by, measures):
    """A report refreshed twice: the second time, half of the dates are new and one has got more rows."""
    rows = t.ev.withColumn("date", F.to_date("ts")).select("date", "event_type", "user_id", "value")
    source = fresh_path(t.spark, "events")
    first = (F.col("date") < "2024-01-16") & ~((F.col("date") == "2024-01-05") & (F.col("event_type") == "error"))
    report = PartialReport(t.spark, source, fresh_path(t.spark, "report"), by, measures)
    for part in (first, ~first):
        rows.filter(part).write.mode("append").partitionBy("date").parquet(source)
        report.refresh()
    return report


@query(
    "s15_refreshed_report",
    "SELECT event_type AS type, count(*) AS n, count(*) FILTER (value > 50) AS high, round(sum(value), 4) AS total,"
    " min(value) AS low, max(value) AS top, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
)
def _(t):
    """Merged from partials per date; the second refresh reads only the dates whose files changed."""
    value = F.col("value")
    measures = {"n": counted(), "high": counted(value > 50), "total": summed(value), "low": lowest(value), "top": highest(value), "mean": averaged(value)}
    found = _refreshed(t, {"type": F.col("event_type")}, measures).result()
    return found.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))


@query(
    "g21_refreshed_median",
    "SELECT event_type AS type, count(*) AS value_tests, true AS near FROM events GROUP BY event_type HAVING count(*) > 10",
)
def _(t):
    """Medians merged from daily sketches; ``near``: their exact ranks are within one hundredth of a half."""
    measures = {"value": quantile(F.col("value")), "value_tests": counted()}
    found = median_map(_refreshed(t, {"event_type": F.col("event_type")}, measures), 10)
    exact = t.ev.select("event_type", F.col("value").alias("own")).join(found, "event_type")
    ranks = exact.groupBy(F.col("event_type").alias("type"), "value_tests").agg(
        F.avg((F.col("own") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("own") <= F.col("value")).cast("int")).alias("upto")
    )
    return ranks.select("type", "value_tests", ((F.col("below") <= 0.51) & (F.col("upto") >= 0.49)).alias("near"))
