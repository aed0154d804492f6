"""Float arithmetic and comparison with IEEE results.

ANSI mode raises on division by zero, and Spark treats NaN as the largest number,
equal to itself.  Ratios and comparisons of samples need IEEE behaviour.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """``a / b`` with NaN for 0/0 and infinities otherwise (the sign of -0 is ignored)."""
    by_zero = (
        F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    )
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def ieee_compare(op: str, a: Column, b: Column) -> Column:
    """Comparison in which NaN is unordered: only ``!=`` holds for it."""
    nan = F.isnan(a) | F.isnan(b)
    if op == "==":
        return ~nan & (a == b)
    if op == "!=":
        return nan | (a != b)
    plain = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return ~nan & plain


def arithmetic(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        return ieee_div(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]
