"""Two-decimal rates, exact and rounded half away from zero, by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_count() -> Column:
    return F.count(F.lit(1))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def pct(part: Column, whole: Column) -> Column:
    """round(100 * part / whole, 2) as double for counts, also of pairs; NULL when `whole` is 0."""
    a, b = part.cast("decimal(30,0)"), whole.cast("decimal(30,0)")
    return _div(20000 * a + b, F.nullif(2 * b, F.lit(0).cast("decimal(30,0)"))) / F.lit(100.0)


def ratio2(numerator: Column, denominator: Column) -> Column:
    """round(numerator / denominator, 2) as double; integers, any sign on top, denominator > 0."""
    a, b = numerator.cast("decimal(30,0)"), denominator.cast("decimal(30,0)")
    size = _div(200 * F.abs(a) + b, F.nullif(2 * b, F.lit(0).cast("decimal(30,0)")))
    return F.signum(a.cast("double")) * size.cast("double") / F.lit(100.0)


def cents(rate: Column) -> Column:
    """A two-decimal rate as a whole number of hundredths, for exact sums."""
    return F.round(rate * 100).cast("bigint")
