"""Streaming jobs give the batch results for any split into micro-batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.model import Grid, vector
from tideline.operators import rangefn as R
from tideline.operators import select as P
from tideline.operators.aggregate import agg
from tideline.plans import alerts as X
from tideline.plans import notify
from tideline.plans.evaluate import AlertRule, Evaluator, eval_rule
from tideline.plans.rules import gauge, missing
from tideline.sources.samples import stream_samples
from tideline.streaming.alerts import stream_alerts, stream_notifications
from tideline.streaming.instants import GaugeRule, absent_instances, stream_absent, stream_gauge_rules, stream_instants
from tideline.streaming.recorded import recorded_samples, stream_recorded
from tideline.streaming.sinks import notification_sink, recorded_sink

START = datetime(2024, 1, 1)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def write_batches(spark, folder, rows, schema, parts):
    """Files that the file source reads one per micro-batch, in order."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = rows[i * size : (i + 1) * size]
        if chunk:
            spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(f"{folder}/in/b{i:03d}")


def source(spark, folder, schema):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.option("recursiveFileLookup", True).parquet(f"{folder}/in")


def run(writer, checkpoint):
    query = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()


ACTIVE = "alert string, series_id string, ts timestamp"


def activity():
    """Minutes with holes around a hold time of five minutes, and a last row far later."""
    runs = {"a": [*range(0, 5), *range(6, 14), *range(20, 40)], "b": [*range(3, 9), 30]}
    rows = [("down", f'{{"k":"{k}"}}', at(m)) for k, ms in runs.items() for m in ms]
    rows.sort(key=lambda r: (r[2], r[1]))
    return rows + [("other", "{}", at(600))]


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_alert_events_equal_batch(spark, folder, parts):
    rows = activity()
    write_batches(spark, folder, rows, ACTIVE, parts)
    events = stream_alerts(source(spark, folder, ACTIVE), "5m", "1m")
    run(events.writeStream.format("parquet").option("path", f"{folder}/out"), folder / "ck")
    got = {
        tuple(r)
        for r in spark.read.parquet(f"{folder}/out").select("series_id", "event", "at").collect()
        if r[0] != "{}"
    }
    states = X.alert_states(spark.createDataFrame(rows, ACTIVE), "5m", "1m")
    intervals = X.alert_intervals(states, "1m").filter("series_id <> '{}'").collect()
    want = {(r.series_id, "firing", r.fired_at) for r in intervals}
    want |= {(r.series_id, "resolved", r.resolved_at) for r in intervals}
    want |= {(r.series_id, "pending", r.since) for r in states.collect() if r.series_id != "{}"}
    assert got == want
    assert any(event == "resolved" for _, event, _ in want)


def test_alert_events_wait_for_late_rows(spark, folder):
    rows = [("down", "{}", at(m)) for m in (0, 1, 3, 2, 4, 5)] + [("down", "x", at(300))]
    write_batches(spark, folder, rows, ACTIVE, len(rows))
    events = stream_alerts(source(spark, folder, ACTIVE), "5m", "1m", lateness="3 minutes")
    run(events.writeStream.format("parquet").option("path", f"{folder}/out"), folder / "ck")
    got = spark.read.parquet(f"{folder}/out").filter("series_id = '{}'").select("event", "at")
    assert sorted(map(tuple, got.collect())) == [
        ("firing", at(5)),
        ("pending", at(0)),
        ("resolved", at(6)),
    ]


SAMPLES = "metric string, labels map<string,string>, ts timestamp, value double"


def counters():
    rows = []
    for machine in ("m1", "m2", "m3"):
        value = 0.0
        for i in range(0, 120):
            value = 0.0 if i % 37 == 5 else value + (i * 7 + len(rows)) % 11
            labels = {"machine": machine, "site": "s1" if machine != "m3" else "s2"}
            # some samples lie exactly on a step
            rows.append(("c_total", labels, at(i + (0 if i % 5 == 0 else 0.25)), value))
    rows.sort(key=lambda r: (r[2], r[1]["machine"]))
    return rows


@pytest.mark.parametrize("parts", [1, 3])
def test_recorded_increase_equals_batch(spark, folder, parts):
    rows = counters() + [("c_total", {"machine": "m9", "site": "s9"}, at(2000), 1.0)]
    write_batches(spark, folder, rows, SAMPLES, parts)
    live = vector(source(spark, folder, SAMPLES))
    recorded = stream_recorded(live, "20m", "5m", ["site"])
    sink = recorded_sink(recorded_samples(recorded, "site:c:increase20m", ["site"]), f"{folder}/out", f"{folder}/ck")
    sink.trigger(availableNow=True).start().awaitTermination()
    got = {
        (r.site, r.ts): r.value
        for r in spark.read.parquet(f"{folder}/out")
        .select(F.col("labels")["site"].alias("site"), "ts", "value")
        .filter("site <> 's9'")
        .collect()
    }
    v = vector(spark.createDataFrame(counters(), SAMPLES))
    grid = Grid.of(START, at(150), "5m")
    batch = agg(R.increase(v, "20m", grid), "sum", ["site"])
    want = {(r.labels["site"], r.ts): r.value for r in batch.collect()}
    assert got.keys() == want.keys()
    rows = spark.read.parquet(f"{folder}/out").count()
    again = recorded_sink(recorded_samples(recorded, "site:c:increase20m", ["site"]), f"{folder}/out", f"{folder}/ck2")
    again.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 2 * rows  # a new checkpoint replaces no row of the first
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-9), key


def state_rows(spark, checkpoint, name, operator):
    reader = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name)
    return reader.load(str(checkpoint))


def test_recording_rule_keeps_one_state_per_slice(spark, folder):
    """A window of 40 steps: no series holds more than 40 slices and the one with the edge, and rows equal the batch."""
    rows = [r for r in counters() if r[1]["machine"] != "m2" or r[2] < at(20)]
    write_batches(spark, folder, rows, SAMPLES, 6)
    recorded = stream_recorded(vector(source(spark, folder, SAMPLES)), "40m", "1m", ["site"])
    run(recorded.writeStream.format("parquet").option("path", f"{folder}/out"), folder / "ck")
    slices = state_rows(spark, folder / "ck", "slices", 1).groupBy("key").count().collect()
    assert slices and all(30 < r["count"] <= 41 for r in slices)
    assert len(slices) == 2  # the series that ended long ago has no state
    waiting = state_rows(spark, folder / "ck", "waiting", 1).count()
    assert waiting <= 3
    got = {(r.site, r.ts): r.value for r in spark.read.parquet(f"{folder}/out").collect()}
    grid = Grid.of(START, max(r[2] for r in rows).replace(microsecond=0), "1m")
    batch = agg(R.increase(vector(spark.createDataFrame(rows, SAMPLES)), "40m", grid), "sum", ["site"])
    want = {(r.labels["site"], r.ts): r.value for r in batch.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def gauges():
    """Two machines that fall silent for a while, one after the other, and a clock that does not."""
    rows = []
    for i in range(0, 240):
        rows.append(("clock", {"machine": "c"}, at(i * 0.5), 1.0))
        for k, machine in enumerate(("m1", "m2")):
            if not 60 + 10 * k <= i < 120 + 30 * k:
                rows.append(("temp", {"machine": machine}, at(i * 0.5 + 0.1 * k), float((i * (7 + k)) % 50)))
    rows.append(("clock", {"machine": "c"}, at(130), 1.0))
    return rows


def replayed(spark, folder, make, parts):
    write_batches(spark, folder, gauges(), SAMPLES, parts)
    out = make(vector(source(spark, folder, SAMPLES)))
    run(out.writeStream.format("parquet").option("path", f"{folder}/out"), folder / "ck")
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("parts", [1, 4])
def test_instants_and_absence_equal_batch(spark, folder, parts):
    v = vector(spark.createDataFrame(gauges(), SAMPLES))
    grid, temp = Grid.of(START, at(130), "1m"), P.sel("temp")
    ev = Evaluator(v, grid, "3m")
    (folder / "a").mkdir()
    (folder / "b").mkdir()
    now = replayed(spark, folder / "a", lambda s: stream_instants(P.select(s, "temp"), START, "1m", "3m"), parts)
    last = at(119.5 + 0.1)  # evaluations that the watermark of the last selected sample has passed
    want = {(r.series_id, r.ts): r.value for r in ev.at(temp).filter(F.col("ts") <= last).collect()}
    rows = now.collect()
    assert {(r.series_id, r.ts): r.value for r in rows} == want and len(rows) == len(want)
    gone = replayed(spark, folder / "b", lambda s: stream_absent(s, temp, START, "1m", "3m"), parts)
    want = sorted((r.series_id, r.ts) for r in ev.absent(temp).filter(F.col("ts") < at(130)).collect())
    assert sorted((r.series_id, r.ts) for r in gone.collect()) == want and len(want) > 10


@pytest.mark.parametrize("parts", [1, 3])
def test_alerts_from_samples_equal_batch(spark, folder, parts):
    """From samples to pending, firing and resolved events in one streaming job."""
    rules = [
        GaugeRule("Hot", P.sel("temp"), ">", 20, {"severity": "page"}, {"summary": "{{ $labels.machine }} at {{ $value }}"}),
        GaugeRule("Cold", P.sel("temp", P.eq("machine", "m1")), "<", 5),
        GaugeRule("Clock", P.sel("clock"), "==", 0),
    ]
    made = replayed(spark, folder, lambda s: stream_alerts(stream_gauge_rules(rules, s, START, "1m", "3m"), "2m", "1m"), parts)
    got = {tuple(r) for r in made.select("alert", "series_id", "event", "at").collect()}
    v = vector(spark.createDataFrame(gauges(), SAMPLES))
    ev = Evaluator(v, Grid.of(START, at(130), "1m"), "3m")
    want = set()
    for rule in rules:
        active = eval_rule(AlertRule(rule.name, gauge(rule.selector, rule.op, rule.k), "2m", rule.labels, rule.annotations), ev)
        states = X.alert_states(active, "2m", "1m")
        intervals = X.alert_intervals(states, "1m").collect()
        want |= {(rule.name, r.series_id, "firing", r.fired_at) for r in intervals}
        want |= {(rule.name, r.series_id, "resolved", r.resolved_at) for r in intervals}
        want |= {(rule.name, r.series_id, "pending", r.since) for r in states.collect()}
    assert got == want and {e for _, _, e, _ in got} == {"pending", "firing", "resolved"}


def test_absence_fires_like_the_batch_rule(spark, folder):
    temp = P.sel("temp", P.eq("machine", "m1"))

    def make(s):
        gone = stream_absent(s, temp, START, "1m", "3m")
        return stream_alerts(absent_instances("Silent", gone, {"severity": "page"}), "5m", "1m")

    got = {tuple(r) for r in replayed(spark, folder, make, 3).select("alert", "series_id", "event", "at").collect()}
    ev = Evaluator(vector(spark.createDataFrame(gauges(), SAMPLES)), Grid.of(START, at(130), "1m"), "3m")
    active = eval_rule(AlertRule("Silent", missing(temp), "5m", {"severity": "page"}), ev)
    intervals = X.alert_intervals(X.alert_states(active, "5m", "1m"), "1m").collect()
    fired = {("Silent", r.series_id, "firing", r.fired_at) for r in intervals}
    assert fired and fired <= got
    assert {g for g in got if g[2] == "resolved"} <= {("Silent", r.series_id, "resolved", r.resolved_at) for r in intervals}


CHANGES = "receiver string, group_key string, ts timestamp, up int, down int"


@pytest.mark.parametrize("parts", [1, 4])
def test_notifications_equal_batch(spark, folder, parts):
    intervals = [
        ("team", "g", at(0), at(7)),
        ("team", "g", at(2), at(30)),
        ("team", "g", at(31), at(32)),
        ("team", "h", at(5), at(2000)),
        ("page", "g", at(11), at(12)),
    ]
    frame = spark.createDataFrame(
        intervals, "receiver string, group_key string, fired_at timestamp, resolved_at timestamp"
    )
    batch = notify.schedule_notifications(frame, at(3000))
    want = sorted(map(tuple, batch.select("receiver", "group_key", "sent_at", "reason", "firing").collect()))
    rows = [(r, g, a, 1, 0) for r, g, a, _ in intervals] + [(r, g, b, 0, 1) for r, g, _, b in intervals]
    rows.sort(key=lambda r: r[2])
    rows.append(("none", "z", at(3000), 0, 1))
    rows.append(("none", "z", at(3001), 0, 1))
    write_batches(spark, folder, rows, CHANGES, parts)
    notes = stream_notifications(source(spark, folder, CHANGES))
    sink = notification_sink(notes, f"{folder}/out", f"{folder}/ck")
    sink.trigger(availableNow=True).start().awaitTermination()
    read = spark.read.parquet(f"{folder}/out").filter("receiver <> 'none'")
    got = sorted(map(tuple, read.select("receiver", "group_key", "sent_at", "reason", "firing").collect()))
    assert got == want
    reasons = {r[3] for r in got}
    assert {"new", "changed", "repeat", "resolved"} <= reasons


def test_stream_samples_reads_new_files(spark, folder):
    spark.createDataFrame(counters(), SAMPLES).write.parquet(f"{folder}/in")
    live = stream_samples(spark, f"{folder}/in")
    run(live.writeStream.format("parquet").option("path", f"{folder}/out"), folder / "ck")
    back = spark.read.parquet(f"{folder}/out")
    assert back.count() == len(counters())
    assert back.select("series_id").distinct().count() == 3
