"""Targets, relabelling, alerts, notifications, reports and storage on small fixtures."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.model import Grid, micros, vector
from tideline.operators import joins as J
from tideline.operators import panels as H
from tideline.operators import relabel as L
from tideline.operators import select as P
from tideline.operators.relabel import Rule
from tideline.plans import alerts as X
from tideline.plans import notify
from tideline.plans.evaluate import AlertRule, Evaluator, eval_rule
from tideline.plans.reports import run_report
from tideline.plans.rules import gauge
from tideline.sources import samples as SRC
from tideline.sources import targets as TG
from tideline.sources.warehouse import scan

T0 = datetime(2024, 1, 1)
SCHEMA = "metric string, labels map<string,string>, ts timestamp, value double"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


GROUPS = [
    {"labels": {"module": "tcp_v4", "service": "web"}, "targets": ["node1-abc01.x:80", "node2-abc02.x:80"]},
    {"labels": {"module": "icmp"}, "targets": ["s1-abc01.x"]},
]


def write_groups(folder):
    (folder / "t").mkdir()
    (folder / "t" / "a.json").write_text(json.dumps(GROUPS, indent=1))


def labels(df):
    return sorted((dict(r.labels) for r in df.collect()), key=lambda d: sorted(d.items()))


def test_target_files(spark, folder):
    write_groups(folder)
    got = labels(TG.read_targets(spark, f"{folder}/t/*.json", {"job": "probe"}))
    assert len(got) == 3
    assert {"module": "icmp", "job": "probe", "__address__": "s1-abc01.x"} in got
    static = labels(TG.static_targets(spark, ["h:1", "h:2"], {"cluster": "inner"}))
    assert static == [{"cluster": "inner", "__address__": "h:1"}, {"cluster": "inner", "__address__": "h:2"}]


def test_target_stream_replaces_the_snapshot(spark, folder):
    write_groups(folder)

    def tick(checkpoint="ck"):
        job = TG.stream_targets(spark, f"{folder}/t", f"{folder}/now", f"{folder}/{checkpoint}")
        job.trigger(once=True).start().awaitTermination()
        return sorted(dict(r.labels)["__address__"] for r in TG.current_targets(spark, f"{folder}/now").collect())

    assert len(tick()) == 3
    (folder / "t" / "b.json").write_text(json.dumps([{"labels": {}, "targets": ["new"]}]))
    assert len(tick()) == 4
    (folder / "t" / "b.json").write_text(json.dumps([{"labels": {}, "targets": ["other"]}]))
    assert "other" in tick() and "new" not in tick()  # rewritten in place
    (folder / "t" / "a.json").unlink()
    assert tick(checkpoint="ck2") == ["other"]  # deleted; a new checkpoint reads on
    # a later version whose writer was lost before it was marked is not seen
    lost = spark.createDataFrame([({"__address__": "part"},)], "labels map<string,string>")
    lost.write.parquet(f"{folder}/now/targets/version={2**60}")
    assert [dict(r.labels)["__address__"] for r in TG.current_targets(spark, f"{folder}/now").collect()] == ["other"]
    TG.mark_version(spark, f"{folder}/now", 2**60)
    assert [dict(r.labels)["__address__"] for r in TG.current_targets(spark, f"{folder}/now").collect()] == ["part"]
    (folder / "t" / "b.json").write_text("[]")


def test_probe_pipeline(spark, folder):
    write_groups(folder)
    rules = [*L.probe_target_rules("exporter:9115"), Rule("labelmap", (), "__param_(.+)")]
    got = labels(L.strip_internal(L.relabel(TG.read_targets(spark, f"{folder}/t/*.json"), rules)))
    first = [g for g in got if g["instance"].startswith("node1")][0]
    assert first == {
        "module": "tcp_v4",
        "service": "web",
        "instance": "node1-abc01.x:80",
        "target": "node1-abc01.x:80",
    }


def test_pipeline_is_the_fold_of_its_rules(spark):
    df = spark.createDataFrame([({"a": "x1", "b": "y"},), ({"a": "z"},)], "labels map<string,string>")
    rules = [
        Rule("replace", ("a",), "x(.)", "n$1", "c"),
        Rule("replace", ("a", "b"), "(.*);(.+)", "${2}-${1}", "d"),
        Rule("labelmap", (), "([ab])", "copy_$1"),
        Rule("drop", ("c",), "n9"),
    ]
    one = df
    for rule in rules:
        one = L.relabel(one, [rule])
    assert labels(L.relabel(df, rules)) == labels(one)
    assert labels(one) == [
        {"a": "x1", "b": "y", "c": "n1", "d": "y-x1", "copy_a": "x1", "copy_b": "y"},
        {"a": "z", "copy_a": "z"},
    ]


def test_equal_series_after_relabelling_are_an_error(spark):
    v = vector(spark.createDataFrame([("m", {"a": "1"}, T0, 1.0), ("m", {"a": "2"}, T0, 2.0)], SCHEMA))
    with pytest.raises(Exception, match="equal series"):
        L.check_unique(L.label_set(v, "a", "same")).collect()


def test_label_clash(spark):
    v = vector(spark.createDataFrame([("m", {"job": "app", "instance": "i", "x": "1"}, T0, 1.0)], SCHEMA))
    target = spark.createDataFrame([({"job": "scrape", "instance": "i"},)], "labels map<string,string>")
    renamed = L.attach_target_labels(v, target, "instance")
    assert labels(renamed) == [{"job": "scrape", "instance": "i", "exported_job": "app", "x": "1"}]
    kept = L.attach_target_labels(v, target, "instance", honor=True)
    assert labels(kept) == [{"job": "app", "instance": "i", "x": "1"}]


def alerts(spark, *rows):
    return spark.createDataFrame(
        [(dict(r)["alertname"], r, T0) for r in rows], "alert string, labels map<string,string>, ts timestamp"
    )


PAGE = {"alertname": "Down", "severity": "page", "page_project": "main", "instance": "i1"}
TICKET = {"alertname": "Slow", "severity": "ticket", "instance": "i1"}
OTHER = {"alertname": "Slow", "severity": "ticket", "instance": "i2"}
SWITCH = {"alertname": "SwitchDown", "severity": "ticket", "site": "abc01"}
BMC = {"alertname": "BmcFailed", "severity": "ticket", "site": "abc01"}
FYI = {"alertname": "Note", "severity": "fyi"}
OWN_FYI = {"alertname": "Note", "severity": "fyi", "fyi_project": "main"}


def test_routing(spark):
    tree = X.Route(
        "tickets",
        routes=(
            X.Route("pages", (P.eq("severity", "page"), P.eq("page_project", "main")), proceed=True),
            X.Route("fyis", (P.eq("severity", "fyi"), P.eq("fyi_project", "main"))),
            X.Route("null", (P.eq("severity", "fyi"),)),
        ),
    )
    routed = X.route(alerts(spark, PAGE, TICKET, FYI, OWN_FYI), tree)
    got = sorted((r.alert, r.labels.get("fyi_project", ""), r.receiver) for r in routed.collect())
    # a page that proceeds past the last route does not also reach the default
    assert got == [
        ("Down", "", "pages"),
        ("Note", "", "null"),
        ("Note", "main", "fyis"),
        ("Slow", "", "tickets"),
    ]
    assert X.discard(routed).count() == 3


def test_inhibition(spark):
    rules = [
        X.Inhibition((P.eq("severity", "page"),), (P.eq("severity", "ticket"),), ("instance", "service")),
        X.Inhibition((P.eq("alertname", "SwitchDown"),), (P.eq("alertname", "BmcFailed"),), ("site",)),
        X.Inhibition((P.eq("alertname", "NoSuchAlert"),), (P.rx("alertname", ".*"),)),
        X.Inhibition((P.eq("alertname", "Note"),), (P.eq("alertname", "Note"),), ()),
    ]
    left = X.inhibit(alerts(spark, PAGE, TICKET, OTHER, SWITCH, BMC, FYI), rules)
    names = sorted((r.alert, r.labels.get("instance", "")) for r in left.collect())
    assert names == [("Down", "i1"), ("Note", ""), ("Slow", "i2"), ("SwitchDown", "")]


def test_hold_boundary(spark):
    rows = [("a", "{}", at(m)) for m in (0, 1, 2, 3, 4, 5, 8, 9)]
    states = X.alert_states(spark.createDataFrame(rows, "alert string, series_id string, ts timestamp"), "5m", "1m")
    got = {r.ts: (r.state, r.since) for r in states.collect()}
    assert got[at(4)] == ("pending", at(0))
    assert got[at(5)] == ("firing", at(0))
    assert got[at(9)] == ("pending", at(8))
    interval = X.alert_intervals(states, "1m").collect()
    assert [(r.fired_at, r.resolved_at) for r in interval] == [(at(5), at(6))]
    quiet = X.alert_intervals(states, "1m", resolve_timeout="60m").collect()
    assert quiet[0].resolved_at == at(65)


def notes(events, end=10_000, **timing):
    scaled = {k: micros(v) for k, v in timing.items()}
    found, _ = notify.advance(
        notify.GroupState(), [(micros(a * 60.0), u, d) for a, u, d in events], micros(end * 60.0), notify.Timing(**scaled)
    )
    return [(t / 60e6, reason, n) for t, reason, n in found]


def test_notification_timing():
    assert notes([(0, 1, 0), (7, 1, 0), (30, 0, 2)]) == [
        (0.5, "new", 1),
        (10.5, "changed", 2),
        (30.5, "resolved", 0),
    ]
    # gone before the first flush: nobody is told
    assert notes([(0, 1, 0), (0.25, 0, 1)]) == []
    # unchanged groups repeat after twelve hours
    assert notes([(0, 1, 0)], end=1500) == [(0.5, "new", 1), (720.5, "repeat", 1), (1440.5, "repeat", 1)]
    # a group that ended starts a new rhythm
    assert [n[:2] for n in notes([(0, 1, 0), (1, 0, 1), (17, 1, 0)], end=100)] == [
        (0.5, "new"),
        (5.5, "resolved"),
        (17.5, "new"),
    ]


def test_group_summary(spark):
    grouped = X.group_alerts(alerts(spark, TICKET, OTHER, PAGE), ["alertname"])
    got = {json.loads(r.group_key)["alertname"]: r for r in X.summarise_group(grouped, ["group_key"]).collect()}
    assert got["Slow"].alerts == 2
    assert json.loads(got["Slow"].common) == {"alertname": "Slow", "severity": "ticket"}
    assert json.loads(got["Down"].common) == PAGE


def test_rule_labels_and_annotations(spark):
    v = vector(spark.createDataFrame([("up", {"job": "j", "cluster": "own"}, T0, 0.0)], SCHEMA))
    rule = AlertRule(
        "Down",
        gauge(P.sel("up"), "==", 0),
        labels={"severity": "page", "cluster": "{{ $labels.cluster }}-x"},
        annotations={"summary": "{{ $labels.job }} is {{ $value }}{{ $labels.none }}"},
    )
    row = eval_rule(rule, Evaluator(v, Grid.of(T0, T0, "1m"))).collect()[0]
    assert row.labels == {"job": "j", "cluster": "own-x", "severity": "page", "alertname": "Down"}
    assert row.annotations == {"summary": "j is 0.0"}


def test_recorded_series_round_trip(spark, folder):
    rows = [("m", {"a": str(i % 3)}, at(600 * i), float(i)) for i in range(12)]
    v = vector(spark.createDataFrame(rows, SCHEMA))
    SRC.write_recorded(v, "a:m:sum", f"{folder}/rec")
    SRC.write_recorded(v, "a:m:other", f"{folder}/rec")
    SRC.write_recorded(v, "a:m:sum", f"{folder}/rec")  # a repeated run
    assert spark.read.parquet(f"{folder}/rec").count() == 24
    days = (date(2024, 1, 2), date(2024, 1, 3))
    back = SRC.read_samples(spark, f"{folder}/rec", days)
    assert {r.metric for r in back.collect()} == {"a:m:sum", "a:m:other"}
    plan = back._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    picked = P.select(back, "a:m:sum")
    assert "PushedFilters: [IsNotNull(metric), EqualTo(metric,a:m:sum)" in picked._jdf.queryExecution().toString()
    assert SRC.retain(v, 2, date(2024, 1, 5)).count() == v.filter("ts >= '2024-01-03'").count()


def test_dedupe(spark):
    rows = [("m", {"a": "1"}, T0, 1.0), ("m", {"a": "1"}, T0, 2.0), ("m", {"a": "2"}, T0, 5.0)]
    v = SRC.dedupe_samples(vector(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(r.value for r in v.collect()) == [2.0, 5.0]


def test_interval_touch(spark):
    """A test that contains a poll does not match; touching ends do."""
    tests = spark.createDataFrame(
        [
            ("contains", "n", at(0), at(60)),
            ("ends_in", "n", at(0), at(10)),
            ("starts_at_end", "n", at(20), at(60)),
            ("other_node", "x", at(10), at(20)),
            ("both", "n", at(12), at(18)),
        ],
        "id string, node string, tstart timestamp, tend timestamp",
    )
    polls = spark.createDataFrame([("n", at(10), at(20), "p")], "node string, tstart timestamp, tend timestamp, poll_id string")
    want = {"ends_in", "starts_at_end", "both"}
    for width in ("10m", "3m", "1d"):
        assert {r.id for r in J.interval_touch_semi(tests, polls, width).collect()} == want
        pairs = J.interval_touch_join(tests, polls, width).collect()
        assert sorted(r.id for r in pairs) == sorted(want)


def test_cumulative_tests_drop_lonely_dates(spark):
    a = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 2),), (date(2024, 1, 3),)], "date date")
    b = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 3),), (date(2024, 1, 3),)], "date date")
    got = run_report("cumulative_tests", first=a, second=b, asof=datetime(2024, 1, 4)).collect()
    assert sorted((r.le, r.value_count) for r in got) == [("-1", 5), ("-2", 2)]


def test_sidecar_needs_more_than_the_limit(spark):
    day = date(2024, 1, 1)
    rows = [(day, f"{s}{i}", (s,)) for s, n in (("a", 1000), ("b", 1001)) for i in range(n)]
    tests = spark.createDataFrame(rows, "date date, id string, server struct<Site:string>")
    traces = tests.filter("id LIKE '%1'")
    got = run_report("sidecar_coverage", tests=tests, traces=traces, asof=datetime(2024, 1, 3)).collect()
    assert [(r.site, r.value_total, r.value_matching) for r in got] == [("b", 1001, 100)]


def test_scalar_helpers(spark):
    assert S.query_date(datetime(2024, 1, 3, 17)) == date(2024, 1, 1)
    assert S.query_date(datetime(2024, 1, 3, 18)) == date(2024, 1, 2)
    df = spark.createDataFrame([(2.5, -2.5, "ab12")], "a double, b double, c string")
    row = df.select(S.to_int64(F.col("a")), S.to_int64(F.col("b")), S.rx_extract(F.col("c"), "z+"), S.rx_extract(F.col("c"), r"\d+"), S.prefix(F.col("c"), 3)).collect()[0]
    assert tuple(row) == (3, -3, None, "12", "ab1")


def test_panel_variables():
    assert P.var_regex(["a.b", "c"]) == r"a\.b|c"
    assert P.var_regex(None) == ".*"


def test_hide_and_fill(spark):
    rows = [("m", {"a": "zero"}, T0, 0.0), ("m", {"a": "one"}, T0, 1.0), ("m", {"a": "one"}, at(1), 0.0)]
    v = vector(spark.createDataFrame(rows, SCHEMA))
    assert {r.labels["a"] for r in H.hide_all(v, "zero").collect()} == {"one"}
    filled = H.null_as_zero(v, Grid.of(T0, at(1), "1m"))
    assert sorted((r.labels["a"], r.value) for r in filled.collect()) == [("one", 0.0), ("one", 1.0), ("zero", 0.0), ("zero", 0.0)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    from checks.registry import QUERIES
    from checks import all_queries

    queries, oracle = all_queries()
    small = "/root/testdata/sf0.001"
    for name in ("r4_increase", "g9_histogram_quantile", "q6_parse_freshness", "x2_alert_states", "l6_rule_chain"):
        plan = plan_of(queries[name](spark, small))
        assert "Python" not in plan and "Pandas" not in plan, name
    assert "LeftAnti" in plan_of(queries["j5_unless_on"](spark, small))
    assert "LeftSemi" in plan_of(queries["j12_interval_touch"](spark, small))
    assert "LeftAnti" in plan_of(queries["j11_zero_fill"](spark, small))
    assert "CartesianProduct" not in plan_of(queries["j12_interval_touch_pairs"](spark, small))
    assert "WindowGroupLimit" in plan_of(queries["g8_topk"](spark, small))
    available = plan_of(queries["g13_availability"](spark, small))
    assert "events.parquet" not in available and "instants-" in available  # the events were scanned once, before
    assert "SinglePartition" not in plan_of(queries["w1_negative_row_number"](spark, small)).split("BroadcastExchange")[0]
    pruned = plan_of(queries["s8_nested_scan"](spark, small))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in pruned
    assert QUERIES


def test_scan_prunes_partitions(spark, folder):
    rows = [(date(2024, 1, d), d) for d in range(1, 11)]
    spark.createDataFrame(rows, "date date, n int").write.partitionBy("date").parquet(f"{folder}/t")
    df = scan(spark, f"{folder}/t", date(2024, 1, 3), date(2024, 1, 4))
    assert "PartitionFilters: [isnotnull(date" in plan_of(df)
    assert df.count() == 2


def test_long_polls_have_few_stretches(spark):
    """A year of ten-minute buckets is covered by two stretches per level at most, each bucket once."""
    polls = spark.createDataFrame(
        [("n", at(0), at(365 * 1440), "year"), ("n", at(3), at(4), "short"), ("n", at(-500), at(777), "before")],
        "node string, tstart timestamp, tend timestamp, poll_id string",
    )
    cover = J._covered(polls, "10m", "node", ["poll_id"]).collect()
    assert max(sum(r.poll_id == name for r in cover) for name in ("year", "short", "before")) < 60
    for row in polls.collect():
        held = [b for r in cover if r.poll_id == row.poll_id for b in range(r._b << r._l, (r._b + 1) << r._l)]
        low, high = (micros(row[c]) // micros("10m") for c in ("tstart", "tend"))
        assert sorted(held) == list(range(low, high + 1))


def test_touch_of_polls_of_any_length(spark):
    import random

    rng = random.Random(6)
    spans = [0, 1, 7, 60, 1440, 20_000]
    tests, polls = ([(i, rng.choice("abc"), s := at(rng.randint(0, 30_000)), s + timedelta(minutes=rng.choice(spans))) for i in range(n)] for n in (400, 60))
    left = spark.createDataFrame([*tests, *tests[:20], (900, None, at(1), at(2)), (901, "a", None, None)], "id int, node string, tstart timestamp, tend timestamp")
    right = spark.createDataFrame(polls, "poll_id int, node string, tstart timestamp, tend timestamp")
    pairs = {(i, p) for i, n, s, e in tests for p, m, lo, hi in polls if n == m and (lo <= s <= hi or lo <= e <= hi)}
    got = J.interval_touch_join(left, right, "10m").select("id", "poll_id").collect()
    assert {tuple(r) for r in got} == pairs and len(got) == len(pairs) + sum(i < 20 for i, _ in pairs)
    kept = sorted(r.id for r in J.interval_touch_semi(left, right, "10m").collect())
    assert kept == sorted([i for i, *_ in tests if i in {x for x, _ in pairs}] + [i for i in range(20) if i in {x for x, _ in pairs}])


def test_running_results_over_many_tasks(spark):
    from itertools import accumulate

    from tideline.operators import tables as U

    rows = [(i % 37 if i % 5 else 20, i, None if i % 11 == 0 else i * 0.5) for i in range(500)]  # a fifth shares one key
    df = spark.createDataFrame(rows, "by int, id int, x double").repartition(7)
    numbered = U.row_number(df, "by", "n", descending=True).collect()
    assert sorted(r.n for r in numbered) == list(range(1, 501))
    assert [r.by for r in sorted(numbered, key=lambda r: r.n)] == sorted((r[0] for r in rows), reverse=True)
    total = U.running_sum(df, "x", "by", "upto").collect()
    last = {}
    for by, _, x in sorted(rows, key=lambda r: r[0]):
        last[by] = last.get(by, 0) + (x or 0)
    ends = dict(zip(sorted(last), accumulate(last[k] for k in sorted(last)), strict=True))
    assert all(max(r.upto for r in total if r.by == k) == ends[k] for k in ends)
    assert U.running_sum(df.limit(0), "x", "by").count() == 0
    plan = plan_of(U.row_number(df, "by", "n"))
    assert "Window" in plan and "SinglePartition" not in plan.split("Window")[1].split("BroadcastExchange")[0]
