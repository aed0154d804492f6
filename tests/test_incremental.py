"""Reports from stored partials: only changed dates are read, and rows equal a full run."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tideline.plans import incremental as I

SCHEMA = "date date, site string, value double, id long"


def rows_of(day: int, n: int, seed: int = 0):
    rng = random.Random(day * 1000 + seed)
    sites = ["a", "b", None]
    return [(date(2024, 1, day), rng.choice(sites), rng.choice([rng.gauss(50, 20), float(rng.randint(0, 5)), None, float("nan")]), rng.randint(0, 99)) for _ in range(n)]


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").partitionBy("date").parquet(f"{folder}/in")


def report(spark, folder):
    measures = {
        "n": I.counted(), "high": I.counted(F.col("value") > 50), "total": I.summed(F.col("id")), "low_id": I.lowest(F.col("id")),
        "top_id": I.highest(F.col("id")), "mean_id": I.averaged(F.col("id")), "value": I.quantile(F.col("value")), "ids": I.distinct(F.col("id")),
    }
    return I.PartialReport(spark, f"{folder}/in", f"{folder}/partials", {"site": F.col("site")}, measures)


EXACT = ["site", "n", "high", "total", "low_id", "top_id", "mean_id"]


def full(rows):
    out = {}
    for site in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == site]
        ids = [r[3] for r in own]
        high = sum(r[2] is not None and (r[2] > 50 or r[2] != r[2]) for r in own)  # NaN is above all numbers
        out[site] = (site, len(own), high, sum(ids), min(ids), max(ids), pytest.approx(sum(ids) / len(ids)))
    return out


def test_only_changed_dates_are_aggregated(spark, folder, monkeypatch):
    first = rows_of(1, 300) + rows_of(2, 200) + rows_of(3, 50)
    write(spark, folder, first)
    own = report(spark, folder)
    assert own.result().count() == 0  # nothing yet
    assert own.refresh() == [date(2024, 1, d) for d in (1, 2, 3)]
    assert {r.site: tuple(r[c] for c in EXACT) for r in own.result().collect()} == full(first)
    assert own.refresh() == []

    read = []
    plain = I.PartialReport.partial
    monkeypatch.setattr(I.PartialReport, "partial", lambda self, rows: read.append(rows) or plain(self, rows))
    late, new = rows_of(2, 40, seed=5), rows_of(4, 70)
    write(spark, folder, late + new)
    again = report(spark, folder)  # as another session would
    assert again.refresh() == [date(2024, 1, 2), date(2024, 1, 4)]
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [date" in plan
    assert {r.date for r in read[0].select("date").distinct().collect()} == {date(2024, 1, 2), date(2024, 1, 4)}
    assert {r.site: tuple(r[c] for c in EXACT) for r in again.result().collect()} == full(first + late + new)
    days = (date(2024, 1, 2), date(2024, 1, 3))
    some = [r for r in first + late if r[0] in days]
    assert {r.site: tuple(r[c] for c in EXACT) for r in again.result(*days).collect()} == full(some)


def test_dates_that_go_and_refreshes_that_are_lost(spark, folder):
    write(spark, folder, rows_of(1, 30) + rows_of(2, 30))
    own = report(spark, folder)
    own.refresh()
    spark.createDataFrame(rows_of(1, 10, seed=9), SCHEMA).drop("date").write.mode("overwrite").parquet(f"{folder}/in/date=2024-01-01")
    for file in (folder / "in" / "date=2024-01-02").iterdir():
        file.unlink()
    # partials of a refresh that was lost before its list was marked do not count
    own.partial(spark.read.parquet(f"{folder}/in")).withColumn("version", F.lit(2**60)).write.mode("append").partitionBy("version", "date").parquet(f"{folder}/partials/partials")
    assert own.refresh() == [date(2024, 1, 1)]
    assert {r.site: tuple(r[c] for c in EXACT) for r in own.result().collect()} == full(rows_of(1, 10, seed=9))


def test_medians_from_daily_sketches_are_close(spark, folder):
    rows = [r for day in range(1, 9) for r in rows_of(day, 4000)]
    write(spark, folder, rows)
    own = I.PartialReport(
        spark, f"{folder}/in", f"{folder}/partials", {"site": F.col("site")}, {"value": I.quantile(F.col("value")), "value_tests": I.counted()}
    )
    own.refresh()
    found = {r.site: r for r in I.median_map(own, 100).collect()}
    assert set(found) == {"a", "b"}
    for site, row in found.items():
        values = sorted(r[2] for r in rows if r[1] == site and r[2] is not None and r[2] == r[2])
        below = sum(v < row.value for v in values) / len(values)
        upto = sum(v <= row.value for v in values) / len(values)
        assert below - 4 / I.SKETCH <= 0.5 <= upto + 4 / I.SKETCH
        assert row.value_tests == sum(r[1] == site for r in rows)


def test_a_tier_refreshes_by_itself(spark, folder):
    write(spark, folder, rows_of(1, 30))
    own = report(spark, folder)
    job = I.refresh_every([own], "5m", f"{folder}/job").trigger(once=True).start()
    job.awaitTermination()
    assert own.refresh() == [] and own.result().count() == 3
