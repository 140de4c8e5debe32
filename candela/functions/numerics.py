"""IEEE-754 behaviour that Spark's operators don't have by themselves.

Spark divides by zero to an error (ANSI) or NULL, takes NaN for the largest value
and calls NaN equal to itself.  The helpers here give binary64 semantics as column
expressions; all take and return DOUBLE columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def number(c: Column) -> Column:
    """The ingest rule: any numeric as DOUBLE, null as NaN."""
    return F.coalesce(c.cast("double"), F.lit(NAN))


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with x/0 = ±Inf, 0/0 = NaN."""
    infinite = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    # -0.0 = 0.0 in Spark; the sign of a zero divisor shows in its text form only.
    negative_zero = b.cast("string") == F.lit("-0.0")
    return F.when(b != 0, F.try_divide(a, b)).otherwise(F.when(negative_zero, -infinite).otherwise(infinite))


def safe_ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """a / b, or a constant where b is zero."""
    return F.when(b != 0, F.try_divide(a, b)).otherwise(F.lit(otherwise))


def gt(a: Column, b: Column) -> Column:
    """a > b, false if either is NaN."""
    return ~F.isnan(a) & ~F.isnan(b) & (a > b)
