"""Numeric column helpers: coercion, clipping, spacing, polynomials."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_of(value) -> Column:
    """A column name, number or Column as a Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def is_finite(value) -> Column:
    """True for real numbers. NaN ranks above infinity in Spark, so one comparison covers both."""
    return F.coalesce(F.abs(col_of(value)) < F.lit(float("inf")), F.lit(False))


def finite(value) -> Column:
    """Column with NaN and infinities turned into NULL."""
    c = col_of(value)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_double(value) -> Column:
    """Cast to double where possible; unreadable text becomes NULL, not an error."""
    return col_of(value).try_cast("double")


def to_double_or(value, default: float | None = 0.0) -> Column:
    """Finite double or the default."""
    return F.coalesce(finite(to_double(value)), F.lit(default).cast("double"))


def number_or(value, default: float = 0.0) -> Column:
    """Numeric coercion that keeps infinities, as table coercion does: NULL/NaN -> default."""
    return F.coalesce(F.nanvl(to_double(value), F.lit(None).cast("double")), F.lit(default))


def total(values) -> Column:
    """Row sum of columns or expressions."""
    return reduce(add, [col_of(v) for v in values])


def clip(value, low=None, high=None) -> Column:
    c = col_of(value)
    if low is not None:
        c = F.greatest(c, col_of(low))
    if high is not None:
        c = F.least(c, col_of(high))
    return c


def half_even(value, digits: int) -> Column:
    """Round to decimals as Python does: to nearest by the exact binary value, true ties to even.

    The product with the power of ten may itself round onto a half. Its rounding
    error is then recovered exactly (splitting the value into two short halves)
    and tells which side the value lies on.
    """
    x, p = col_of(value).cast("double"), float(10 ** digits)
    product = x * p
    nearest = F.rint(product)
    spread = x * 134217729.0  # 2**27 + 1
    high = spread - (spread - x)
    error = (high * p - product) + (x - high) * p
    tie = F.abs(product - nearest) == 0.5
    whole = F.when(tie & (error > 0), product + 0.5).when(tie & (error < 0), product - 0.5).otherwise(nearest)
    # From 2**52 on a double has no such decimals left to round.
    return F.when(F.abs(product) < 4503599627370496.0, whole / p).otherwise(x)


def linspace(low, high, n: int, index) -> Column:
    """Value at position ``index`` (0-based) of ``n`` evenly spaced points."""
    lo, hi, i = col_of(low), col_of(high), col_of(index)
    if n == 1:
        return lo
    return F.when(i == n - 1, hi).otherwise(lo + i * ((hi - lo) / F.lit(float(n - 1))))


def logspace(low, high, n: int, index) -> Column:
    """Value at position ``index`` of ``n`` points evenly spaced in log10."""
    return F.pow(F.lit(10.0), linspace(F.log10(col_of(low)), F.log10(col_of(high)), n, index))


def polynomial(coefficients, x) -> Column:
    """Horner evaluation; the highest power comes first."""
    xc = col_of(x)
    out = col_of(coefficients[0])
    for c in coefficients[1:]:
        out = out * xc + col_of(c)
    return out


def polynomial_text(coefficients: list[float], variable: str = "log10(stress)") -> str:
    """Readable form of a fitted polynomial, six decimals per coefficient."""
    degree = len(coefficients) - 1
    suffix = {0: "", 1: f"*{variable}"}
    return " + ".join(
        f"{c:.6f}" + suffix.get(degree - i, f"*{variable}^{degree - i}")
        for i, c in enumerate(coefficients)
    )


def numeric_columns(df: DataFrame) -> list[str]:
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
