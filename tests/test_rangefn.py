"""Range functions against a list-based model, on every plan of the window kernel."""

import math
import random
from datetime import datetime, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.model import Grid, micros, vector
from tideline.operators import rangefn as R
from tideline.operators import slices
from tideline.sources.samples import bucketed_samples, write_bucketed

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
BASE = micros(START)
SECOND = 1_000_000
SCHEMA = "labels map<string,string>, us long, value double"


def frame(spark, series):
    rows = [({"s": name}, BASE + at, float(v)) for name, points in series.items() for at, v in points]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("labels", "timestamp_micros(us) AS ts", "value")
    return vector(df, "m_total")


def collect(df):
    return {(r.labels["s"], micros(r.ts.replace(tzinfo=timezone.utc)) - BASE): r.value for r in df.collect()}


def random_series(seed, n=12, length=60):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        at, value, points = 0, 0.0, []
        for _ in range(length):
            # exact multiples of the step, gaps longer than the window, and resets
            at += rng.choice([30, 60, 60, 15, 7, 45, 60, 400 if i % 3 == 0 else 60]) * SECOND
            value = rng.choice([0.0, 1.0]) if rng.random() < 0.12 else value + rng.randint(0, 9)
            points.append((at, value))
        out[f"s{i}"] = points
    return out


def model_increase(points, lo, hi, d):
    if len(points) < 2:
        return None
    grown = points[-1][1] - points[0][1]
    grown += sum(a[1] for a, b in zip(points, points[1:]) if b[1] < a[1])
    covered = (points[-1][0] - points[0][0]) / 1e6
    gap = covered / (len(points) - 1)
    start, end = (points[0][0] - lo) / 1e6, (hi - points[-1][0]) / 1e6
    if start >= gap * 1.1:
        start = gap / 2
    if grown > 0 and points[0][1] >= 0:
        start = min(start, covered * points[0][1] / grown)
    if end >= gap * 1.1:
        end = gap / 2
    return grown * (covered + start + end) / covered


def model_irate(points, lo, hi, d):
    if len(points) < 2:
        return None
    (t0, v0), (t1, v1) = points[-2:]
    return (v1 - (0 if v1 < v0 else v0)) / ((t1 - t0) / 1e6)


def model_line(points, lo, hi, d):
    if len(points) < 2:
        return None
    x = np.array([(t - hi) / 1e6 for t, _ in points])
    y = np.array([v for _, v in points])
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    return y.mean() + slope * (120.0 - x.mean())


MODELS = {
    "increase": (model_increase, lambda v, d, g: R.increase(v, d, g)),
    "irate": (model_irate, lambda v, d, g: R.irate(v, d, g)),
    "resets": (
        lambda p, lo, hi, d: float(sum(b[1] < a[1] for a, b in zip(p, p[1:]))),
        lambda v, d, g: R.resets(v, d, g),
    ),
    "sum": (lambda p, lo, hi, d: sum(v for _, v in p), lambda v, d, g: R.over_time(v, "sum", d, g)),
    "avg": (lambda p, lo, hi, d: sum(v for _, v in p) / len(p), lambda v, d, g: R.over_time(v, "avg", d, g)),
    "count": (lambda p, lo, hi, d: float(len(p)), lambda v, d, g: R.over_time(v, "count", d, g)),
    "min": (lambda p, lo, hi, d: min(v for _, v in p), lambda v, d, g: R.over_time(v, "min", d, g)),
    "max": (lambda p, lo, hi, d: max(v for _, v in p), lambda v, d, g: R.over_time(v, "max", d, g)),
    "last": (lambda p, lo, hi, d: p[-1][1], lambda v, d, g: R.over_time(v, "last", d, g)),
    "predict": (model_line, lambda v, d, g: R.predict_linear(v, d, 120.0, g)),
    "quantile": (
        lambda p, lo, hi, d: float(np.percentile([v for _, v in p], 70)),
        lambda v, d, g: R.over_time(v, "quantile", d, g, q=0.7),
    ),
}


def expected(series, model, d, grid):
    out = {}
    for name, points in series.items():
        for t in range(grid.start, grid.end + 1, grid.step):
            hi = t - BASE
            inside = [p for p in points if hi - d <= p[0] <= hi]
            value = model(inside, hi - d, hi, d) if inside else None
            if value is not None:
                out[name, hi] = value
    return out


# window, step: equal, multiple, not a multiple, shorter than the step
SHAPES = [("5m", "1m"), ("1m", "1m"), ("7m", "2m"), ("90s", "1m"), ("30s", "2m")]


@pytest.mark.parametrize("plan", ["direct", "spread", "blocks"])
@pytest.mark.parametrize("name", list(MODELS))
def test_against_model(spark, monkeypatch, plan, name):
    if plan != "direct":
        monkeypatch.setattr(slices, "DIRECT", 0)
    if plan == "blocks":
        monkeypatch.setattr(slices, "SPREAD", 0)
    series = random_series(7)
    model, fn = MODELS[name]
    v = frame(spark, series).cache()
    shapes = SHAPES if name in ("increase", "sum") else SHAPES[:1] + SHAPES[2:3]
    for d, step in shapes:
        grid = Grid.of(START, micros(START) / 1e6 + 3000, step)
        got, want = collect(fn(v, d, grid)), expected(series, model, micros(d), grid)
        assert got.keys() == want.keys(), (d, step)
        for key in want:
            assert got[key] == pytest.approx(want[key], rel=1e-9, abs=1e-9), (d, step, key)


def test_long_window(spark):
    series = random_series(3, n=3, length=200)
    grid = Grid.of(START, micros(START) / 1e6 + 9000, "1m")
    got = collect(R.increase(frame(spark, series), "100m", grid))
    want = expected(series, model_increase, micros("100m"), grid)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 1200), st.integers(0, 5)), min_size=1, max_size=40, unique_by=lambda p: p[0]),
    st.sampled_from(["3m", "10m", "45s"]),
)
def test_increase_on_any_series(spark, points, d):
    series = {"s": sorted((at * SECOND, float(v)) for at, v in points)}
    grid = Grid.of(START, micros(START) / 1e6 + 1500, "1m")
    got = collect(R.increase(frame(spark, series), d, grid))
    want = expected(series, model_increase, micros(d), grid)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)


def test_rate_is_increase_per_second(spark):
    v = frame(spark, random_series(1, n=2))
    grid = Grid.of(START, micros(START) / 1e6 + 2000, "1m")
    grown, per_second = collect(R.increase(v, "5m", grid)), collect(R.rate(v, "5m", grid))
    assert grown.keys() == per_second.keys()
    assert all(per_second[k] * 300 == pytest.approx(grown[k]) for k in grown)


def test_counter_fixture(spark):
    """1,3,5,2,4,9,12,1 every minute: closed window edges, two resets."""
    points = [(i * 60 * SECOND, v) for i, v in enumerate([1, 3, 5, 2, 4, 9, 12, 1])]
    v = frame(spark, {"s": points})
    grid = Grid.of(START, micros(START) / 1e6 + 420, "1m")
    assert collect(R.increase(v, "7m", grid, mode="raw"))["s", 420 * SECOND] == 17
    assert collect(R.resets(v, "7m", grid))["s", 420 * SECOND] == 2
    assert collect(R.irate(v, "5m", grid))["s", 420 * SECOND] == pytest.approx(1 / 60)
    assert collect(R.over_time(v, "count", "2m", grid))["s", 420 * SECOND] == 3


def test_instant_lookback_and_nan(spark):
    points = [(0, 1.0), (60 * SECOND, math.nan), (480 * SECOND, 3.0)]
    v = frame(spark, {"s": points})
    grid = Grid.of(START, micros(START) / 1e6 + 540, "1m")
    got = collect(R.instant(v, grid, "5m"))
    assert math.isnan(got["s", 360 * SECOND])
    assert ("s", 420 * SECOND) not in got
    assert got["s", 540 * SECOND] == 3.0
    assert collect(R.over_time(v, "max", "9m", grid))["s", 540 * SECOND] == 3.0
    named = R.instant(v, grid, "5m").select("metric").distinct().collect()
    assert [r.metric for r in named] == ["m_total"]


def test_offset_and_subquery_alignment(spark):
    v = frame(spark, random_series(5, n=2))
    grid = Grid.of(START, micros(START) / 1e6 + 1800, "1m")
    shifted = collect(R.instant(v, grid, "5m", shift="10m"))
    assert shifted == collect(R.instant(R.offset(v, "10m"), grid, "5m"))
    seen = []
    R.subquery(lambda g: seen.append(g), "30m", "7m", grid)
    assert seen[0].start % (7 * 60 * SECOND) == 0
    assert grid.start - micros("30m") <= seen[0].start < grid.start - micros("30m") + micros("7m")


def test_rate_interval():
    assert R.rate_interval("15s", "60s") == micros("4m")
    assert R.rate_interval("10m", "60s") == micros("11m")


def test_stored_by_day_is_folded_in_place(spark, folder):
    """Samples bucketed by series and day: equal rows, and no exchange below the first aggregate."""
    series = random_series(11, n=6, length=400)
    series["edge"] = [(h * 3600 * SECOND, float(h)) for h in range(60)]  # some exactly at midnight
    v = frame(spark, series)
    table = f"samples_{folder.name.replace('-', '_')}"
    write_bucketed(v, table, f"{folder}/table", 4)
    stored = bucketed_samples(spark, table)
    end = micros(START) / 1e6 + 2.5 * 86400
    for fn in (
        lambda x, g: R.increase(x, "6h", g), lambda x, g: R.rate(x, "30m", g), lambda x, g: R.irate(x, "1h", g),
        lambda x, g: R.resets(x, "1d", g), lambda x, g: R.over_time(x, "sum", "1d", g), lambda x, g: R.instant(x, g, "2h"),
    ):
        grid = Grid.of(START, end, "30m")
        want, got = fn(v, grid), fn(stored, grid)
        assert collect(got) == pytest.approx(collect(want), rel=1e-9, abs=1e-9)
        lines = got._jdf.queryExecution().sparkPlan().toString(), got._jdf.queryExecution().executedPlan().toString()
        below = []
        for line in reversed(lines[1].split("== Initial Plan ==")[-1].strip().splitlines()):
            if "Aggregate" in line:
                break
            below.append(line)
        assert any("Bucketed: true" in line for line in below), lines[1]
        assert not any("Exchange" in line for line in below), lines[1]
    odd = Grid.of(micros(START) / 1e6 + 11, end, "61s")  # days do not end at cuts
    assert collect(R.over_time(stored, "sum", "2h", odd)) == pytest.approx(collect(R.over_time(v, "sum", "2h", odd)), rel=1e-9)
    pruned = bucketed_samples(spark, table, (START.date(), START.date()))
    assert "PartitionFilters: [isnotnull(date" in pruned._jdf.queryExecution().executedPlan().toString()


def test_work_of_a_long_window_does_not_grow_with_it(spark):
    """Rows between the samples and the evaluations: slices and changes, not slices times their number in a window."""
    v = frame(spark, random_series(2, n=2, length=30))
    for d in ("90m", "1d", "30d"):
        grid = Grid.of(START, micros(START) / 1e6 + 40 * 86400, "61s")
        plan = R.over_time(v, "sum", d, grid)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("sequence(") <= 2 * plan.count("Generate explode(sequence(at")
        assert plan.count("Window [") <= 8


def test_nan_stays_in_its_window(spark):
    points = [(i * 60 * SECOND, math.nan if i == 100 else float(i)) for i in range(300)]
    grid = Grid.of(START, micros(START) / 1e6 + 18000, "1m")
    got = collect(R.over_time(frame(spark, {"s": points}), "sum", "70m", grid))
    for t in range(0, 301):
        inside = [v for at, v in points if (t - 70) * 60 * SECOND <= at <= t * 60 * SECOND]
        value = got["s", t * 60 * SECOND]
        assert math.isnan(value) if 100 <= t <= 170 else value == pytest.approx(sum(inside))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.7, 1.0, 1.5, math.nan])
def test_sliding_quantile_of_long_windows(spark, q):
    rng = random.Random(8)
    series = {
        "normal": [(i * 53 * SECOND, rng.gauss(0, 100)) for i in range(300)],
        "few": [(i * 97 * SECOND, float(rng.choice([0, 0, 0, 1, 2]))) for i in range(200)],
        "odd": [(i * 61 * SECOND, rng.choice([math.nan, math.inf, -math.inf, 5.0, 5.0, -0.5])) for i in range(150)],
        "gaps": [(i * 1117 * SECOND, float(i)) for i in range(20)],
        "nan": [(600 * SECOND, math.nan)],
    }
    grid = Grid.of(START, micros(START) / 1e6 + 30000, "45s")
    found = R.over_time(frame(spark, series), "quantile", "70m", grid, q=q)
    got, want = collect(found), expected(series, lambda p, lo, hi, d: model_quantile(p, q), micros("70m"), grid)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], rel=1e-9, abs=1e-9, nan_ok=True), key


@pytest.mark.parametrize("q", [0.0, 0.25, 0.7, 1.0, 1.5, math.nan])
def test_quantile_of_windows_with_few_samples(spark, q):
    """The step of a subquery bounds the samples of a window; without it the same rows come another way."""
    rng = random.Random(9)
    odd = [math.nan, math.inf, -math.inf, 5.0, 5.0, -0.5]
    minutes = {"all": range(300), "some": sorted(rng.sample(range(300), 80)), "far": [0, 1, 150, 299], "odd": range(0, 300, 2)}
    series = {s: [(m * 60 * SECOND, rng.choice(odd) if s == "odd" else rng.gauss(0, 9)) for m in at] for s, at in minutes.items()}
    v = frame(spark, series)
    v = v.unionByName(v.selectExpr("metric", "labels", "series_id", "ts", "CAST(NULL AS double) AS value"))
    for d, step in (("7m", "1m"), ("20m", "45s"), ("3m", "11m"), ("0s", "1m")):
        grid = Grid.of(START, micros(START) / 1e6 + 17000, step)
        known = R.subquery(lambda g: v, d, "1m", grid)
        found, other = R.over_time(known, "quantile", d, grid, q=q), R.over_time(v, "quantile", d, grid, q=q)
        assert ["inline(" in x._jdf.queryExecution().optimizedPlan().toString() for x in (found, other)] == [0 <= q <= 1, False]
        got, want = collect(found), expected(series, lambda p, lo, hi, d: model_quantile(p, q), micros(d), grid)
        assert got.keys() == want.keys() == collect(other).keys()
        for key in want:
            assert got[key] == pytest.approx(want[key], rel=1e-9, abs=1e-9, nan_ok=True), (d, key)


def test_windows_with_many_samples_are_not_gathered(spark):
    v = frame(spark, {"s": [(i * SECOND, float(i)) for i in range(5)]})
    grid = Grid.of(START, micros(START) / 1e6 + 3600, "1m")
    for step, gathered in (("3s", True), ("1s", False)):
        plan = R.over_time(R.subquery(lambda g: v, "10m", step, grid), "quantile", "10m", grid, q=0.5)._jdf.queryExecution()
        assert ("collect_list" in plan.optimizedPlan().toString()) == gathered


def model_quantile(points, q):
    if math.isnan(q) or q > 1:
        return q if math.isnan(q) else math.inf
    values = sorted((v for _, v in points), key=lambda v: (v != v, v))
    rank = q * (len(values) - 1)
    low, high = values[math.floor(rank)], values[math.ceil(rank)]
    w = rank - math.floor(rank)
    return low if w == 0 else low * (1 - w) + high * w
