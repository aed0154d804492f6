"""Rule expressions: every alert condition the platform uses, as a function of selectors.

Each function returns an expression ``Evaluator -> vector`` for an ``AlertRule``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tideline.operators.aggregate import (
    agg,
    availability,
    bucket_share,
    seasonal_low,
    stopped_since,
)
from tideline.operators.matching import binop, v_or, v_or_all, v_unless
from tideline.operators.relabel import label_replace, label_set
from tideline.operators.select import Selector
from tideline.operators.vector import (
    age,
    arith,
    compare,
    remaining,
    scalar,
    vabs,
    with_scalar,
)
from tideline.plans import alerts
from tideline.plans.evaluate import Evaluator, Expression

DAY = 86400.0


def _or(parts: list[DataFrame]) -> DataFrame:
    return reduce(v_or, parts)



def gauge(selector: Selector, op: str, k: float) -> Expression:
    """A gauge compared with a constant."""
    return lambda ev: compare(ev.at(selector), op, k)


def down_or_missing(selector: Selector) -> Expression:
    return lambda ev: alerts.down_or_missing(ev, selector)


def missing(*selectors: Selector) -> Expression:
    """Any of several selections has no series."""
    return lambda ev: _or([ev.absent(s) for s in selectors])


def missing_for(selector: Selector, d) -> Expression:
    return lambda ev: ev.absent_over_time(selector, d)


def restarts(selector: Selector, d, more_than: float) -> Expression:
    return lambda ev: compare(ev.resets(selector, d), ">", more_than)


def stale(selector: Selector, seconds: float) -> Expression:
    """A last-success time lies too far back."""
    return lambda ev: compare(age(ev.at(selector)), ">", seconds)


def expiring(selector: Selector, by: list[str], days: float) -> Expression:
    def expr(ev: Evaluator) -> DataFrame:
        left = arith(remaining(ev.at(selector)), "/", DAY)
        return compare(agg(left, "min", by), "<", days)

    return expr


def suppressed(inner: Expression, *silencers: tuple[list[str], Expression]) -> Expression:
    """``inner unless on(labels) silencer …``."""

    def expr(ev: Evaluator) -> DataFrame:
        out = inner(ev)
        for on, silencer in silencers:
            out = v_unless(out, silencer(ev), on=on)
        return out

    return expr


def plain(selector: Selector) -> Expression:
    return lambda ev: ev.at(selector)


def any_expr(*parts: Expression) -> Expression:
    """``a or b or c``."""
    return lambda ev: v_or_all(*[p(ev) for p in parts])


def summed_over_time(selector: Selector, d, op: str, k: float) -> Expression:
    return lambda ev: compare(ev.over_time("sum", selector, d), op, k)


def share(part: Selector, whole: Selector, op: str, k: float, d=None, by=None, or_missing=False):
    """Share of a selection in a wider one; with ``d`` of their rates.

    Without a series in the part there is no row, which is why missing input is a case
    of its own.
    """

    def expr(ev: Evaluator) -> DataFrame:
        read = ev.at if d is None else (lambda s: ev.rate(s, d))
        ratio = binop("/", agg(read(part), "sum", by), agg(read(whole), "sum", by))
        found = compare(ratio, op, k)
        return v_or(found, ev.absent(whole)) if or_missing else found

    return expr


def slow_share(buckets: Selector, bound: str, d, below: float) -> Expression:
    """Too few observations under a latency bound."""
    return lambda ev: compare(bucket_share(ev.increase(buckets, d), bound, ev.grid), "<", below)


def files_stopped(counter: Selector, by: list[str], d, everything: Selector) -> Expression:
    """Groups that grew in the window before and not in this one, or no counter at all."""

    def expr(ev: Evaluator) -> DataFrame:
        now = agg(ev.increase(counter, d), "sum", by)
        then = agg(ev.increase(counter, d, shift=d), "sum", by)
        return v_or(stopped_since(now, then), ev.absent(everything))

    return expr


def counts_differ(a: Selector, by: list[str], b: Selector, ignoring: list[str], shift, more: float):
    """Two independent counts of the same thing lie too far apart."""

    def expr(ev: Evaluator) -> DataFrame:
        left = agg(ev.at(a), "sum", by)
        delta = binop("-", left, ev.at(b, shift), ignoring=ignoring)
        return compare(vabs(delta), ">", more)

    return expr


def report_ratio(a: Selector, b: Selector, op: str, k: float, or_missing: str | None = None):
    """Ratio of two report gauges; ``or_missing`` is ``"ratio"`` or ``"denominator"``."""

    def expr(ev: Evaluator) -> DataFrame:
        ratio = binop("/", ev.at(a), ev.at(b))
        found = compare(ratio, op, k)
        if or_missing == "ratio":
            return v_or(found, ev.missing(ratio))
        return v_or(found, ev.absent(b)) if or_missing else found

    return expr


def grown(counter: Selector, d, op: str, k: float, by: list[str] | None = None) -> Expression:
    """Increase of a counter (summed by labels) compared with a constant."""

    def expr(ev: Evaluator) -> DataFrame:
        found = ev.increase(counter, d)
        return compare(found if by is None else agg(found, "sum", by), op, k)

    return expr


def last_rate(counter: Selector, d, op: str, k: float) -> Expression:
    return lambda ev: compare(ev.irate(counter, d), op, k)


def total(selector: Selector, scale: float, op: str, k: float) -> Expression:
    """Scaled sum of a gauge over all series."""
    return lambda ev: compare(arith(agg(ev.at(selector), "sum"), "/", scale), op, k)


def counted(inner: Expression, by: list[str], op: str, k: float) -> Expression:
    return lambda ev: compare(agg(inner(ev), "count", by), op, k)


def earlier_than(a: Selector, b: Selector) -> Expression:
    """Series whose first gauge is below their second."""
    return lambda ev: binop("<", ev.at(a), ev.at(b))


def relabelled(inner: Expression, dst: str, replacement: str, src: str, regex: str) -> Expression:
    return lambda ev: label_replace(inner(ev), dst, replacement, src, regex)


def share_left(free: Selector, size: Selector, below: float) -> Expression:
    return lambda ev: compare(binop("/", ev.at(free), ev.at(size)), "<", below)


def above_average(values: list[Selector], average: Selector, factor: float) -> Expression:
    """Any of several gauges above a multiple of their average."""

    def expr(ev: Evaluator) -> DataFrame:
        limit = arith(ev.at(average), "*", factor)
        return _or([binop(">", ev.at(v), limit) for v in values])

    return expr


def rows_per_count(rows: Selector, counter: Selector, d, shift, below: float) -> Expression:
    """Stored rows over counted tests."""

    def expr(ev: Evaluator) -> DataFrame:
        counted_tests = agg(ev.increase(counter, d, shift), "sum")
        ratio = with_scalar(
            counted_tests, "/", scalar(ev.at(rows), ev.instants), reverse=True
        )
        return compare(ratio, "<", below)

    return expr


def volume_low(selector: Selector, delays: dict[str, str], by: list[str], fraction: float):
    """A series below a fraction of its own median some days earlier; ``delays`` by name."""

    def expr(ev: Evaluator) -> DataFrame:
        earlier = {name: ev.at(selector, shift) for name, shift in delays.items()}
        return seasonal_low(ev.at(selector), earlier, by, fraction)

    return expr


def fleet_unavailable(
    probe: Selector,
    group: str,
    value: str,
    size: Selector | None,
    free: Selector | None,
    disk_limit: float,
    excluded: list[Selector],
    own_flags: list[Selector],
    maintenance: Selector,
    known: Selector,
    member: str,
    below: float,
    extra_probes: tuple[Selector, ...] = (),
) -> Expression:
    """Too few healthy members of a service.

    A member is healthy when its probes succeed, its disk is not full and no exclusion
    flag is set; the worst signal counts.  ``excluded`` flags get the service label,
    ``own_flags`` carry it.  Members in maintenance that the cluster knows nothing
    about are left out of the denominator.
    """

    def expr(ev: Evaluator) -> DataFrame:
        signals = [ev.at(probe), *[ev.at(p) for p in extra_probes]]
        if size is not None:
            used = binop("/", binop("-", ev.at(size), ev.at(free)), ev.at(size))
            signals.append(compare(label_set(used, group, value), "<", disk_limit, as_bool=True))
        flags = [label_set(ev.at(x), group, value) for x in excluded]
        flags += [ev.at(x) for x in own_flags]
        flags.append(label_set(ev.at(maintenance), group, value))
        signals += [compare(f, "!=", 1, as_bool=True) for f in flags]
        excused = v_unless(compare(ev.at(maintenance), "==", 1), ev.at(known), on=[member])
        found = availability(signals, ev.at(probe), excused, [group, member])
        return compare(found, "<", below)

    return expr


def recorded_increase(counter: Selector, d, by: list[str]) -> Expression:
    """Recording rule ``sum by(labels) (increase(counter[d]))``."""
    return lambda ev: agg(ev.increase(counter, d), "sum", by)


