"""Numbers: finite values, robust casts, and driver-side scalars that SQL lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite(x: Column) -> Column:
    """x, or null where it isn't finite."""
    return F.when(is_finite(x), x)


def finite_or_zero(x: Column) -> Column:
    """x, or 0 where it isn't finite."""
    return F.coalesce(finite(x), F.lit(0.0))


def safe_float(text: Column, default: float = 0.0) -> Column:
    """A text as a finite double, else the default; never raises."""
    return F.coalesce(finite(F.trim(text).try_cast("double")), F.lit(default))


def safe_ln(x: Column) -> Column:
    """The natural logarithm of a positive finite number, else null."""
    return F.when(is_finite(x) & (x > 0), F.ln(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def norm_cdf(x: float) -> float:
    """The standard normal distribution function, for scalars on the driver."""
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def norm_ppf(p: float) -> float:
    """Its inverse, by bisection; for scalars on the driver."""
    if not 0.0 < p < 1.0:
        return math.nan if not 0.0 <= p <= 1.0 else math.copysign(math.inf, p - 0.5)
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if norm_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
