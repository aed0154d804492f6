"""Matching, aggregation, quantiles and histograms on small fixtures."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions.floats import ieee_compare, ieee_div
from tideline.model import Grid, vector
from tideline.operators import aggregate as G
from tideline.operators import histogram as H
from tideline.operators import select as P
from tideline.operators import vector as A
from tideline.operators.matching import binop, or_default, v_and, v_or, v_or_all, v_unless
from tideline.operators.quantile import exact_quantile
from tideline.plans import rules
from tideline.plans.evaluate import Evaluator

T0 = datetime(2024, 1, 1)
SCHEMA = "metric string, labels map<string,string>, ts timestamp, value double"


def vec(spark, *rows, metric="m", ts=T0):
    return vector(spark.createDataFrame([(metric, labels, ts, float(x)) for labels, x in rows], SCHEMA))


def values(v, *labels):
    rows = v.collect()
    return sorted((*[r.labels.get(x, "") for x in labels], r.value) for r in rows)


def grid():
    return Grid.of(T0, T0, "1m")


def test_empty_label_equals_missing(spark):
    v = vec(spark, ({"a": "1", "b": ""}, 1), ({"a": "2"}, 2))
    assert {r.series_id for r in v.collect()} == {'{"a":"1"}', '{"a":"2"}'}
    assert P.select(v, "m", P.eq("b", "")).count() == 2
    assert P.select(v, "m", P.ne("b", "")).count() == 0


def test_label_order_does_not_matter(spark):
    a = vec(spark, ({"x": "1", "y": "2"}, 6))
    b = vec(spark, ({"y": "2", "x": "1"}, 3), metric="other")
    assert values(binop("/", a, b), "x", "y") == [("1", "2", 2.0)]


def test_regex_is_anchored(spark):
    v = vec(spark, ({"h": "s1.abc"}, 1), ({"h": "xs1.abc"}, 2), ({"h": "s1.abc\n"}, 3))
    assert values(P.select(v, None, P.rx("h", "s1.ab."))) == [(1.0,)]
    assert values(P.select(v, None, P.nrx("h", "s1.*c")))[0] == (2.0,)


def test_one_to_one_matching(spark):
    a = vec(spark, ({"i": "1", "e": "x"}, 10), ({"i": "2", "e": "x"}, 20), ({"i": "9"}, 1))
    b = vec(spark, ({"i": "1", "e": "x"}, 4), ({"i": "2", "e": "y"}, 5))
    assert values(binop("-", a, b), "i") == [("1", 6.0)]
    assert values(binop("-", a, b, ignoring=["e"]), "i", "e") == [("1", "", 6.0), ("2", "", 15.0)]
    assert values(binop("-", a, b, on=["i"]), "i") == [("1", 6.0), ("2", 15.0)]
    kept = binop(">", a, b).collect()
    assert [(r.metric, r.value) for r in kept] == [("m", 10.0)]
    assert binop(">", a, b, as_bool=True).collect()[0].metric is None


def test_many_to_many_is_an_error(spark):
    a = vec(spark, ({"i": "1", "e": "x"}, 1), ({"i": "1", "e": "y"}, 2))
    with pytest.raises(Exception, match="several series share one match key"):
        binop("+", a, a, on=["i"]).collect()


def test_set_operators(spark):
    a = vec(spark, ({"i": "1"}, 1), ({"i": "2"}, 2), ({"i": "3", "s": "z"}, 3))
    b = vec(spark, ({"i": "2"}, 20), ({"i": "4", "s": "z"}, 40), metric="b")
    assert values(v_and(a, b), "i") == [("2", 2.0)]
    assert values(v_unless(a, b), "i") == [("1", 1.0), ("3", 3.0)]
    both = sorted(values(v_and(a, b), "i") + values(v_unless(a, b), "i"))
    assert both == values(a, "i")
    assert values(v_unless(a, b, on=["s"]), "i") == []
    chain = v_or(v_or(a, b), vec(spark, ({"i": "4", "s": "z"}, 7), ({"i": "5"}, 5)))
    flat = v_or_all(a, b, vec(spark, ({"i": "4", "s": "z"}, 7), ({"i": "5"}, 5)))
    assert values(chain, "i") == values(flat, "i")
    two_names = vec(spark, ({"i": "1"}, 1)).unionByName(vec(spark, ({"i": "1"}, 2), metric="n"))
    assert len(v_or_all(two_names, a).filter("series_id = '{\"i\":\"1\"}'").collect()) == 2


def test_empty_vectors(spark):
    empty = P.select(vec(spark, ({"i": "1"}, 1)), "nothing")
    instants = grid().instants(spark)
    assert G.agg(empty, "sum").count() == 0
    assert G.agg(empty, "count", ["i"]).count() == 0
    assert math.isnan(A.scalar(empty, instants).collect()[0].value)
    assert values(A.absent_vector(empty, instants, {"job": "x"}), "job") == [("x", 1.0)]
    assert values(or_default(empty, 0, grid())) == [(0.0,)]
    # no failures: no ratio at all
    some = vec(spark, ({"status": "OK"}, 5))
    assert G.ratio(some, P.ne("status", "OK")).count() == 0


def test_absent_labels_come_from_single_equalities():
    s = P.sel("up", P.eq("job", "a"), P.rx("instance", ".*"), P.eq("x", "1"), P.ne("x", "2"))
    assert s.equal_labels() == {"job": "a"}


def test_ieee_floats(spark):
    nan, inf = math.nan, math.inf
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (nan, 0.0), (6.0, 3.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(ieee_div(F.col("a"), F.col("b"))).collect()]
    assert got[0] == inf and got[1] == -inf and math.isnan(got[2]) and math.isnan(got[3]) and got[4] == 2
    df = spark.createDataFrame([(nan, 1.0)], "a double, b double")
    for op in ("==", ">", "<", ">=", "<="):
        assert df.select(ieee_compare(op, F.col("a"), F.col("b"))).collect()[0][0] is False
    assert df.select(ieee_compare("!=", F.col("a"), F.col("b"))).collect()[0][0] is True


def test_nan_in_min_and_max(spark):
    v = vec(spark, ({"g": "a", "i": "1"}, math.nan), ({"g": "a", "i": "2"}, 2), ({"g": "b", "i": "1"}, math.nan))
    assert values(P.select(G.agg(v, "max", ["g"]), None, P.eq("g", "a"))) == [(2.0,)]
    assert values(P.select(G.agg(v, "min", ["g"]), None, P.eq("g", "a"))) == [(2.0,)]
    assert math.isnan(values(P.select(G.agg(v, "max", ["g"]), None, P.eq("g", "b")))[0][0])


def test_topk_ties_and_nan(spark):
    v = vec(spark, ({"i": "a"}, 5), ({"i": "b"}, 5), ({"i": "c"}, 5), ({"i": "d"}, math.nan))
    assert values(G.topk(v, 2), "i") == [("a", 5.0), ("b", 5.0)]


@pytest.mark.parametrize("q", [0.0, 0.013, 0.5, 0.95, 0.9999, 1.0])
def test_exact_quantile_of_large_and_small_groups(spark, q):
    rng = random.Random(11)
    groups = {
        "wide": [rng.gauss(0, 1e6) for _ in range(60_000)],
        "few": [float(rng.randint(0, 3)) for _ in range(40_000)],
        "tail": [math.exp(rng.random() * 40) for _ in range(30_000)],
        "small": [5.0, 1.0, 9.0],
        "one": [4.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    got = {r.g: r.v for r in exact_quantile(df, ["g"], "v", q).collect()}
    for name, vs in groups.items():
        assert got[name] == pytest.approx(np.percentile(vs, q * 100), rel=1e-12), name


def test_quantile_out_of_range(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    assert exact_quantile(df, ["g"], "v", 1.5).collect()[0].v == math.inf
    assert exact_quantile(df, ["g"], "v", -1).collect()[0].v == -math.inf


def buckets(spark, **hists):
    rows = [({"le": le, "h": h}, n) for h, cells in hists.items() for le, n in cells]
    return vec(spark, *rows)


def test_histogram_quantile_edges(spark):
    v = buckets(
        spark,
        plain=[("1", 10), ("5", 30), ("10", 40), ("+Inf", 40)],
        dip=[("1", 10), ("5", 8), ("10", 20), ("+Inf", 20)],
        zero=[("1", 0), ("5", 0), ("+Inf", 0)],
        top=[("1", 1), ("5", 2), ("+Inf", 100)],
        open=[("1", 1), ("5", 2)],
    )
    got = {r.labels["h"]: r.value for r in H.histogram_quantile(v, 0.5).collect()}
    assert got["plain"] == pytest.approx(1 + 4 * (20 - 10) / 20)
    assert got["dip"] == pytest.approx(1.0)  # the dip is lifted to 10
    assert math.isnan(got["zero"])
    assert got["top"] == 5.0
    assert math.isnan(got["open"])
    low = {r.labels["h"]: r.value for r in H.histogram_quantile(v, 0.1).collect()}
    assert low["plain"] == pytest.approx(0.4)
    assert all(r.value == math.inf or math.isnan(r.value) for r in H.histogram_quantile(v, 2).collect())


def test_histogram_quantile_grows_with_q(spark):
    v = buckets(spark, a=[("0.5", 3), ("1", 9), ("2.5", 20), ("+Inf", 25)])
    found = [H.histogram_quantile(v, q).collect()[0].value for q in (0.05, 0.3, 0.6, 0.8, 0.99)]
    assert found == sorted(found)


def test_bucket_share_and_heatmap(spark):
    v = buckets(spark, a=[("1", 10), ("5", 30), ("+Inf", 40)])
    assert values(G.bucket_share(v, "5", grid())) == [(0.75,)]
    counts = {r.le: r.value for r in H.heatmap(v).collect()}
    assert counts == {1.0: 10.0, 5.0: 20.0, math.inf: 10.0}


def test_fleet_rule(spark):
    """Three machines: healthy, full disk, in maintenance but unknown to the cluster."""

    def rows(metric, per, **extra):
        return vec(spark, *[({"machine": m, **extra}, x) for m, x in per.items()], metric=metric)

    parts = [
        rows("probe", {"m1": 1, "m2": 1, "m3": 1}, experiment="web", service="s"),
        rows("size", {"m1": 100, "m2": 100}, mount="/d"),
        rows("avail", {"m1": 50, "m2": 1}, mount="/d"),
        rows("maint", {"m1": 0, "m3": 1}),
        rows("node", {"m1": 1, "m2": 1}),
        rows("taint", {"m1": 0}),
    ]
    samples = parts[0]
    for part in parts[1:]:
        samples = samples.unionByName(part)
    ev = Evaluator(samples, grid())
    expr = rules.fleet_unavailable(
        probe=P.sel("probe"),
        group="experiment",
        value="web",
        size=P.sel("size"),
        free=P.sel("avail"),
        disk_limit=0.95,
        excluded=[P.sel("taint")],
        own_flags=[],
        maintenance=P.sel("maint"),
        known=P.sel("node"),
        member="machine",
        below=0.9,
    )
    # m1 healthy, m2 disk full: 0, m3 in maintenance: 0 and not in the denominator
    assert values(expr(ev)) == [(0.5,)]


def test_rule_for_missing_and_sites_down(spark):
    samples = vec(spark, ({"site": "a", "machine": "a1", "v6": "present"}, 0), ({"site": "b", "machine": "b1", "v6": "present"}, 0), metric="probe6")
    samples = samples.unionByName(vec(spark, ({"machine": "b1"}, 0), metric="probe4"))
    ev = Evaluator(samples, grid())
    down = rules.suppressed(
        rules.gauge(P.sel("probe6", P.eq("v6", "present")), "==", 0),
        (["machine"], rules.any_expr(rules.gauge(P.sel("probe4"), "==", 0), rules.gauge(P.sel("maint"), "==", 1))),
    )
    assert values(rules.counted(down, ["site"], ">", 0)(ev), "site") == [("a", 1.0)]
    found = rules.missing(P.sel("x", P.eq("service", "s1")), P.sel("y"), P.sel("probe4"))(ev)
    assert values(found, "service") == [("", 1.0), ("s1", 1.0)]


def test_files_stopped(spark):
    from datetime import timedelta

    def growth(name, values_):
        return [
            ("files", {"e": name}, T0 + timedelta(hours=6 * i), float(v)) for i, v in enumerate(values_)
        ]

    rows = growth("stopped", [0, 5, 9, 12, 14, 14, 14, 14, 14]) + growth("alive", range(0, 18, 2))
    v = vector(spark.createDataFrame(rows, SCHEMA))
    day2 = Grid.of(T0 + timedelta(days=2), T0 + timedelta(days=2), "1m")
    ev = Evaluator(v, day2, lookback="1d")
    assert values(rules.files_stopped(P.sel("files"), ["e"], "1d", P.sel("files"))(ev), "e") == [("stopped", 0.0)]
