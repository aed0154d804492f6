"""Range-vector functions, instant lookup, offsets and subqueries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.model import Grid, micros
from tideline.operators import slices
from tideline.operators.quantile import exact_quantile
from tideline.operators.sliding_quantile import gathered_quantile, sliding_quantile
from tideline.operators.slices import SERIES, Family, as_vector, in_reach, windows

#: Name of the step of a vector's instants in the metadata of ``ts``.
STEP = "step"
#: Windows that are known to have at most so many samples of a series are sorted in memory.
FEW = 256

COUNT = Family(
    build="named_struct('n', count(value))",
    edge="named_struct('n', 1L)",
    merge="named_struct('n', a.n + b.n)",
    gather="named_struct('n', sum(c.n))",
    running="named_struct('n', sum(state.n) {w})",
)
SUM = Family(
    build="named_struct('n', count(value), 's', sum(value))",
    edge="named_struct('n', 1L, 's', {y})",
    merge="named_struct('n', a.n + b.n, 's', a.s + b.s)",
    gather="named_struct('n', sum(c.n), 's', sum(c.s))",
    running="named_struct('n', sum(state.n) {w}, 's', sum(state.s) {w})",
)
LOW = Family(
    build="named_struct('s', min(value))",
    edge="named_struct('s', {y})",
    merge="named_struct('s', least(a.s, b.s))",
    gather="named_struct('s', min(c.s))",
    running="named_struct('s', min(state.s) {w})",
)
HIGH = Family(  # NaN is the largest value in Spark; it must not win
    build="named_struct('s', max(CASE WHEN NOT isnan(value) THEN value END))",
    edge="named_struct('s', CASE WHEN NOT isnan({y}) THEN {y} END)",
    merge="named_struct('s', greatest(a.s, b.s))",
    gather="named_struct('s', max(c.s))",
    running="named_struct('s', max(state.s) {w})",
)
LAST = Family(
    build="named_struct('x', max(x), 'value', max_by(value, x))",
    edge="named_struct('x', {x}, 'value', {y})",
    merge="b",
    gather="named_struct('x', max(c.x), 'value', max_by(c.value, c.x))",
    running="named_struct('x', max(state.x) {w}, 'value', max_by(state.value, state.x) {w})",
)
_FELL = "before_x >= w0 AND c.first.value < before_value"
COUNTER = Family(
    ordered=True,
    build=(
        "named_struct('n', count(value), 'first', named_struct('x', min(x), 'value', min_by(value, x)),"
        " 'last', named_struct('x', max(x), 'value', max_by(value, x)),"
        " 'lost', sum(CASE WHEN value < prev_value THEN prev_value ELSE 0D END),"
        " 'resets', count_if(value < prev_value))"
    ),
    edge=(
        "named_struct('n', 1L, 'first', named_struct('x', {x}, 'value', {y}),"
        " 'last', named_struct('x', {x}, 'value', {y}), 'lost', 0D, 'resets', 0L)"
    ),
    merge=(
        "named_struct('n', a.n + b.n, 'first', a.first, 'last', b.last, 'lost', a.lost + b.lost"
        " + CASE WHEN b.first.value < a.last.value THEN a.last.value ELSE 0D END, 'resets',"
        " a.resets + b.resets + CASE WHEN b.first.value < a.last.value THEN 1L ELSE 0L END)"
    ),
    gather=(
        "named_struct('n', sum(c.n), 'first', named_struct('x', min(c.first.x), 'value', min_by(c.first.value, c.first.x)),"
        " 'last', named_struct('x', max(c.last.x), 'value', max_by(c.last.value, c.last.x)),"
        f" 'lost', sum(c.lost + CASE WHEN {_FELL} THEN before_value ELSE 0D END),"
        f" 'resets', sum(c.resets + CASE WHEN {_FELL} THEN 1L ELSE 0L END))"
    ),
    running=(
        "named_struct('n', sum(state.n) {w}, 'first', min(state.first) {w}, 'last', max(state.last) {w}, 'lost', sum(state.lost"
        " + CASE WHEN later.first.value < earlier.last.value THEN earlier.last.value ELSE 0D END) {w}, 'resets', sum(state.resets"
        " + CASE WHEN later.first.value < earlier.last.value THEN 1L ELSE 0L END) {w})"
    ),
)
PAIR = Family(
    ordered=True,
    build=(
        "named_struct('last', named_struct('x', max(x), 'value', max_by(value, x)),"
        " 'prev', named_struct('x', max_by(prev_x, x), 'value', max_by(prev_value, x)))"
    ),
    edge=(
        "named_struct('last', named_struct('x', {x}, 'value', {y}),"
        " 'prev', named_struct('x', CAST(NULL AS bigint), 'value', CAST(NULL AS double)))"
    ),
    merge="named_struct('last', b.last, 'prev', CASE WHEN b.prev.x IS NULL THEN a.last ELSE b.prev END)",
    gather=(
        "named_struct('last', named_struct('x', max(c.last.x), 'value', max_by(c.last.value, c.last.x)), 'prev', named_struct("
        "'x', max_by(coalesce(c.prev.x, CASE WHEN before_x >= w0 THEN before_x END), c.last.x),"
        " 'value', max_by(CASE WHEN c.prev.x IS NOT NULL THEN c.prev.value WHEN before_x >= w0 THEN before_value END, c.last.x)))"
    ),
    running=(  # the sample before the last one ends a slice or is second in it
        "named_struct('last', max(state.last) {w}, 'prev', coalesce(greatest(max(CASE WHEN state.prev.x IS NOT NULL"
        " THEN state.prev END) {w}, max(earlier.last) {w}), named_struct('x', CAST(NULL AS bigint), 'value', CAST(NULL AS double))))"
    ),
)
REGRESSION = Family(  # means and centred sums, which merge without cancellation
    build=(
        "named_struct('n', CAST(count(value) AS double), 'mx', avg(x / 1e6D), 'my', avg(value),"
        " 'sxx', regr_sxx(value, x / 1e6D), 'sxy', regr_sxy(value, x / 1e6D))"
    ),
    edge="named_struct('n', 1D, 'mx', {x} / 1e6D, 'my', {y}, 'sxx', 0D, 'sxy', 0D)",
    merge=(
        "named_struct('n', a.n + b.n, 'mx', a.mx + (b.mx - a.mx) * b.n / (a.n + b.n),"
        " 'my', a.my + (b.my - a.my) * b.n / (a.n + b.n),"
        " 'sxx', a.sxx + b.sxx + (b.mx - a.mx) * (b.mx - a.mx) * a.n * b.n / (a.n + b.n),"
        " 'sxy', a.sxy + b.sxy + (b.mx - a.mx) * (b.my - a.my) * a.n * b.n / (a.n + b.n))"
    ),
    running=(  # around a point of the frame itself, so little cancels
        "named_struct('n', sum(state.n) {w}, 'mx', origin.mx + sum(state.n * _X) {w} / sum(state.n) {w},"
        " 'my', origin.my + sum(state.n * _Y) {w} / sum(state.n) {w},"
        " 'sxx', sum(state.sxx + state.n * _X * _X) {w} - sum(state.n * _X) {w} * sum(state.n * _X) {w} / sum(state.n) {w},"
        " 'sxy', sum(state.sxy + state.n * _X * _Y) {w} - sum(state.n * _X) {w} * sum(state.n * _Y) {w} / sum(state.n) {w})"
    ).replace("_X", "(state.mx - origin.mx)").replace("_Y", "(state.my - origin.my)"),
)


def offset(v: DataFrame, d) -> DataFrame:
    """Shift samples so that an evaluation sees the values of ``d`` earlier."""
    return v.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.lit(micros(d))))


def instant(v: DataFrame, grid: Grid, lookback="5m", shift=0) -> DataFrame:
    """Latest sample of each series within the lookback, at every evaluation."""
    out = windows(v, micros(lookback), grid, LAST, micros(shift))
    return as_vector(out, "state.value", keep_name=True)


def over_time(v: DataFrame, how: str, d, grid: Grid, shift=0, q: float | None = None) -> DataFrame:
    """``sum|avg|count|min|max|last|quantile`` of the samples in each trailing window."""
    span, off = micros(d), micros(shift)
    if how == "quantile":
        return _quantile_over_time(v, q, span, grid, off)
    family, value = {
        "sum": (SUM, "state.s"),
        "avg": (SUM, "state.s / state.n"),
        "count": (COUNT, "state.n"),
        "min": (LOW, "state.s"),
        "max": (HIGH, "coalesce(state.s, double('NaN'))"),
        "last": (LAST, "state.value"),
    }[how]
    return as_vector(windows(v, span, grid, family, off), value, keep_name=how == "last")


def _quantile_over_time(v: DataFrame, q: float, d: int, grid: Grid, off: int) -> DataFrame:
    near = in_reach(v, grid, d, off).select(*SERIES, "x", "value")
    first = F.greatest(F.lit(0), F.ceil((F.col("x") - F.lit(d)) / F.lit(grid.step)))
    last = F.least(F.lit(grid.last), F.call_function("div", F.col("x"), F.lit(grid.step)))
    held = near.select(*SERIES, "value", first.alias("first"), last.alias("final"))
    if d > slices.SPREAD * grid.step:
        out = sliding_quantile(held, q, d // grid.step + 1, grid.last)
    elif 0 <= q <= 1 and _spaced(v, d // FEW):
        out = gathered_quantile(held, q, d // grid.step + 1)
    else:
        # Counts per value merge: samples that lie in the same windows are counted once, and
        # only these counts are repeated for the windows.
        same = near.groupBy(*SERIES, first.alias("first"), last.alias("last"), "value")
        counts = same.agg(F.count(F.lit(1)).alias("n"))
        spread = counts.select(*SERIES, "value", "n", F.explode(F.sequence("first", "last")).alias("j"))
        out = exact_quantile(spread, [*SERIES, "j"], "value", q, weight="n")
    ts = F.timestamp_micros(F.lit(grid.start) + F.col("j") * F.lit(grid.step))
    return as_vector(out.withColumn("ts", ts), "value")


def _spaced(v: DataFrame, least: int) -> bool:
    """Whether instants are known to lie more than ``least`` microseconds apart."""
    return v.schema["ts"].metadata.get(STEP, 0) > least


def increase(v: DataFrame, d, grid: Grid, shift=0, mode: str = "extrapolated") -> DataFrame:
    """Growth of a counter over the window, extrapolated towards its edges.

    The samples are assumed to continue to an edge that is nearer than 1.1 average gaps,
    else for half a gap; at the start never to before the counter was zero.
    """
    span = micros(d)
    out = windows(v, span, grid, COUNTER, micros(shift)).filter("state.n > 1")
    out = out.selectExpr(
        *SERIES,
        "ts",
        "state.last.value - state.first.value + state.lost AS grown",
        "state.first.value AS first",
        "(state.last.x - state.first.x) / 1e6D AS covered",
        "(state.last.x - state.first.x) / 1e6D / (state.n - 1) AS gap",
        # states count x from the first window's start
        f"(state.first.x - (unix_micros(ts) - {grid.start})) / 1e6D AS to_start",
        f"(unix_micros(ts) - {grid.start - span} - state.last.x) / 1e6D AS to_end",
    )
    if mode == "raw":
        return as_vector(out, "grown")
    out = out.selectExpr(
        "*",
        "CASE WHEN to_start >= gap * 1.1D THEN gap / 2 ELSE to_start END AS start",
        "CASE WHEN to_end >= gap * 1.1D THEN gap / 2 ELSE to_end END AS end",
    )
    capped = "CASE WHEN grown > 0 AND first >= 0 THEN least(start, covered * (first / grown)) ELSE start END"
    return as_vector(out, f"grown * ((covered + {capped} + end) / covered)")


def rate(v: DataFrame, d, grid: Grid, shift=0, mode: str = "extrapolated") -> DataFrame:
    out = increase(v, d, grid, shift, mode)
    return out.withColumn("value", F.col("value") / (micros(d) / 1e6))


def irate(v: DataFrame, d, grid: Grid, shift=0) -> DataFrame:
    """Rate between the last two samples; after a reset the counter restarted from zero."""
    out = windows(v, micros(d), grid, PAIR, micros(shift)).filter("state.prev.x IS NOT NULL")
    base = "CASE WHEN state.last.value < state.prev.value THEN 0D ELSE state.prev.value END"
    return as_vector(
        out, f"(state.last.value - {base}) / ((state.last.x - state.prev.x) / 1e6D)"
    )


def resets(v: DataFrame, d, grid: Grid, shift=0) -> DataFrame:
    return as_vector(windows(v, micros(d), grid, COUNTER, micros(shift)), "state.resets")


def predict_linear(v: DataFrame, d, seconds: float, grid: Grid, shift=0) -> DataFrame:
    """Least-squares line through the window, read ``seconds`` after the evaluation."""
    span = micros(d)
    out = windows(v, span, grid, REGRESSION, micros(shift)).filter("state.n > 1")
    ahead = f"(unix_micros(ts) - {grid.start - span}) / 1e6D + {float(seconds)}D"
    return as_vector(out, f"state.my + state.sxy / state.sxx * ({ahead} - state.mx)")


def subquery(inner: Callable[[Grid], DataFrame], d, step, grid: Grid) -> DataFrame:
    """Evaluate ``inner`` on its own grid, aligned to multiples of ``step``, as samples.

    The step is kept in the metadata of ``ts``: it bounds the samples of a window, and changes no result.
    """
    size = micros(step)
    start = -(-(grid.start - micros(d)) // size) * size
    found = inner(Grid(start, grid.start + grid.last * grid.step, size))
    return found.withMetadata("ts", {STEP: size}) if isinstance(found, DataFrame) else found


def rate_interval(step, scrape) -> int:
    """Window a panel uses for rates: at least four scrapes, in microseconds."""
    return max(micros(step) + micros(scrape), 4 * micros(scrape))
