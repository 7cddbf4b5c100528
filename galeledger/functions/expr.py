"""Null-aware arithmetic: clips, floors, guarded ratios, weighted means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_nan(x) -> Column:
    """NaN is a missing value at the boundary; inside the engine only NULL is."""
    x = as_col(x)
    return F.when(~F.isnan(x), x)


def finite(x) -> Column:
    """x, or NULL when x is NaN or infinite."""
    x = as_col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clip(x, lo, hi) -> Column:
    """Bound x to [lo, hi]; NULL stays NULL (``greatest`` alone would skip it)."""
    x = as_col(x)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.greatest(lo, F.least(hi, x)))


def max_of_known(a, b) -> Column:
    """Larger of two values, NULL as soon as one is unknown."""
    a, b = as_col(a), as_col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def floored_price(merchant, strike, supported=True) -> Column:
    """Realised price: the strike is a floor while the support scheme is on."""
    merchant = as_col(merchant)
    with_floor = max_of_known(merchant, strike)
    if supported is True:
        return with_floor
    return F.when(as_col(supported) == 1, with_floor).otherwise(merchant)


def support_premium(merchant, strike, supported=True) -> Column:
    """max(0, strike - merchant), zero when the support scheme is off."""
    gap = max_of_known(F.lit(0.0), as_col(strike) - as_col(merchant))
    if supported is True:
        return gap
    return F.when(as_col(supported) == 1, gap).otherwise(F.lit(0.0))


def guarded_ratio(num, den, default=None) -> Column:
    """num/den where den > 0, otherwise ``default``."""
    num, den = as_col(num), as_col(den)
    fallback = F.lit(None).cast("double") if default is None else F.lit(float(default))
    return F.when(den > 0, num / den).otherwise(fallback)


def ratio_unless_zero(num, den) -> Column:
    num, den = as_col(num), as_col(den)
    return F.when(den != 0, num / den)


def weighted_mean(value, weight) -> Column:
    """Aggregate: unknown weights count as 0; NULL unless the weights sum above 0.

    A row whose value is unknown still adds its weight to the denominator.
    """
    w = F.coalesce(as_col(weight), F.lit(0.0))
    return F.when(F.sum(w) > 0, F.sum(as_col(value) * w) / F.sum(w))


def total(x) -> Column:
    """Aggregate sum in which an empty or all-unknown group is 0."""
    return F.coalesce(F.sum(as_col(x)), F.lit(0.0))


def row_sum(cols) -> Column:
    """Sum across columns, skipping unknowns; 0 for no columns."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_col(c), F.lit(0.0)) for c in cols], F.lit(0.0))
