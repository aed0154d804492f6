"""Plans and rows of queries that stopped on larger tables."""

import math
from datetime import datetime

import pytest
from pyspark.sql import Row

from checks import all_queries
from tideline.model import Grid, vector
from tideline.operators import rangefn as R
from tideline.operators.aggregate import agg, merged
from tideline.operators.joins import _covered
from tideline.operators.matching import binop
from tideline.operators.panels import null_as_zero
from tideline.operators.relabel import Rule, relabel
from tideline.streaming.alerts import HoldProcessor

QUERIES = all_queries()[0]


@pytest.fixture
def tables(spark, folder):
    """A folder with a few events of several users, in the shape of the driver's table."""
    rows = [
        (i, datetime(2024, 1, 1 + i % 5, i % 24, (7 * i) % 60), i % 3, ["click", "view"][i % 2], float(i % 13))
        for i in range(60)
    ]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["r12_predict_linear", "r10_quantile_over_subquery", "a4_binop_one_to_one"])
def test_repeated_rows_are_not_broadcast(spark, tables, name):
    """Spark takes rows repeated per evaluation for as few as before, and sent them through the driver."""
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, tables))


def test_work_of_a_rule_chain_grows_with_its_rules(spark):
    """The map of one rule is formed once, not in each of its uses by later rules and filters."""

    def uses(n):
        rules = [Rule("replace", ("a", f"t{i}"), "(.*);(.*)", "$1$2", f"t{i + 1}") for i in range(n)]
        rows = spark.createDataFrame([(1, {"a": "x", "t0": "y"}), (2, {"a": "z"})], "k long, labels map<string,string>")
        return relabel(rows, [*rules, Rule("drop", (f"t{n}",), "z.*")])

    assert {r.k: r.labels for r in uses(3).collect()} == {1: {"a": "x", "t0": "y", "t1": "xy", "t2": "xxy", "t3": "xxxy"}}
    found = [uses(n)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") for n in (2, 4)]
    assert found[1] == 2 * found[0]


class Store:
    """A state variable and the timers of one key, counting what is asked of it."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, []

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + rows

    def appendValue(self, row):
        self.appendList([row])

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_an_alert_instance_has_one_timer(folder):
    """However many evaluations wait, as a timer each made the state machine run for each."""
    machine, store = HoldProcessor(3_600_000, 60_000), Store()
    machine.handle = machine.waiting = store
    rows = [Row(alert="a", series_id="s", at_ms=60_000 * i) for i in (3, 1, 2, *range(1, 500))]
    assert list(machine.handleInputRows(("a", "s"), iter(rows), None)) == []
    assert store.timers == [60_000] and store.calls == 3
    assert [at for at, in store.rows] == [60_000 * i for i in range(1, 500)]


@pytest.mark.parametrize("step", ["61s", "7m", "1h"])
def test_sums_of_merged_series_equal_sums_of_series(spark, step):
    """Also where samples of several series lie on the same edge of a window; null and NaN too."""
    start = datetime(2024, 1, 1)
    grid = Grid.of(start, datetime(2024, 1, 1, 6), step)
    at = [(j * grid.step * (1 + i % 2)) // 1000 * 1000 for i in range(3) for j in range(12)]
    rows = [({"type": "ab"[n % 2], "usr": str(n)}, grid.start + x + 1_000_000 * (n % 4), float(n) if n % 9 else None) for n, x in enumerate(at)]
    rows += [({"type": t, "usr": f"u{u}"}, grid.start + 3 * grid.step, float(u)) for t in "ab" for u in range(7)]
    rows.append(({"type": "c", "usr": "1"}, grid.start + 5 * grid.step, math.nan))
    v = spark.createDataFrame(rows, "labels map<string,string>, us long, value double").selectExpr("labels", "timestamp_micros(us) AS ts", "value")
    v = vector(v, "m")

    def sums(x):
        found = agg(R.over_time(x, "sum", "2h", grid), "sum", ["type"])
        return {(r.labels["type"], r.ts): r.value for r in found.collect()}

    each, once = sums(v), sums(merged(v, ["type"]))
    assert each.keys() == once.keys()
    for key in each:
        assert once[key] == pytest.approx(each[key], rel=1e-12, nan_ok=True), key
    groups = merged(v, ["type"]).select("series_id").distinct().collect()
    assert sorted(g.series_id for g in groups) == ['{"type":"a"}', '{"type":"b"}', '{"type":"c"}']


def test_null_as_zero_between_samples_off_and_on_the_grid(spark):
    grid = Grid(1_000_000_000, 1_000_000_000 + 5 * 60_000_000, 60_000_000)
    at = [grid.start + j * grid.step for j in range(6)]
    points = {
        "on": {at[0]: 1.0, at[3]: 2.0, at[5]: None},
        "off": {at[1] + 7: 3.0, at[1] + 9: 4.0, at[4]: 5.0},
        "out": {at[0] - 90_000_000: 6.0, at[5] + 1: 7.0},
        "none": {None: 8.0, at[2]: 9.0},
    }
    rows = [({"s": s}, us, x) for s, found in points.items() for us, x in found.items()] * 2
    rows.append(({"s": "on"}, at[3], -1.0))  # of one instant the largest counts
    v = spark.createDataFrame(rows, "labels map<string,string>, us long, value double").selectExpr("labels", "timestamp_micros(us) AS ts", "value")
    found = null_as_zero(vector(v, "m"), grid)
    got = sorted(((r.labels["s"], r.us or -1, r.value) for r in found.selectExpr("labels", "unix_micros(ts) AS us", "value").collect()))
    want = {(s, us or -1): x or 0.0 for s, values in points.items() for us, x in {**dict.fromkeys(at), **values}.items()}
    assert got == sorted((*key, x) for key, x in want.items())
    below = found._jdf.queryExecution().executedPlan().toString().split("Generate explode(sequence")[-1]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and "Exchange" in below


def test_polls_of_two_buckets_take_one_level(spark):
    """A point has a row per level, so polls of two buckets that start at even ones take no level of their own."""
    day = 86_400
    polls = spark.createDataFrame([(1, i * day, (i + 1) * day) for i in range(9)] + [(1, 20 * day, 27 * day)], "node long, s long, e long")
    polls = polls.selectExpr("node", "timestamp_seconds(s) AS tstart", "timestamp_seconds(e) AS tend")
    found = [(r._s.timestamp(), r._l, r._b) for r in _covered(polls, "1d", "node").collect()]
    assert {l for s, l, _ in found if s < 20 * day} == {0}
    assert sorted((l, b) for s, l, b in found if s == 20 * day) == [(2, 5), (2, 6)]
    for i in range(9):
        assert sorted(b for s, _, b in found if s == i * day) == [i, i + 1]


def test_sides_of_an_operator_meet_in_one_aggregation(spark, tables):
    """Rows repeated per evaluation were aggregated on both sides, sorted and joined."""
    found = plan(QUERIES["a4_binop_one_to_one"](spark, tables))
    assert "Join" not in found

    rows = [("m", "{}", 1, 4.0), ("m", "{}", 2, None), ("m", None, 1, 1.0), ("m", "{}", None, 1.0), ("m", "x", 1, 8.0)]
    left = spark.createDataFrame(rows, "metric string, series_id string, ts int, value double")
    right = spark.createDataFrame([(None, *r[1:3], 2.0) for r in rows[:4]], left.schema)
    for op, want in (("/", {(None, 1, 2.0), (None, 2, None)}), (">", {("m", 1, 4.0)})):
        assert {(r.metric, r.ts, r.value) for r in binop(op, left, right).collect()} == want
    assert binop("+", left.where("series_id = 'x'").unionByName(left.where("value = 4")), right).count() == 1  # without a partner, no error
    with pytest.raises(Exception, match="share one match key"):
        binop("+", left.unionByName(left), right).collect()


def test_samples_of_a_subquery_are_not_shuffled_repeated(spark, tables):
    """Each was repeated for its windows, and the repeated rows went through eight shuffles."""
    found = QUERIES["r10_quantile_over_subquery"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    above, *below = found.split("Exchange")
    assert "Generate inline(transform(sequence(" in above and len(below) == 2
