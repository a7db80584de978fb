"""Ordered-window expressions of a bar series; all are causal unless said otherwise."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(*keys: str, order: str = "bar_s") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def rolling(agg: Column, x: Column, w: WindowSpec, size: int, least: int | None = None) -> Column:
    """agg over the last `size` rows, null before `least` (default: size) of them have a value."""
    own = w.rowsBetween(-(size - 1), 0)
    return F.when(F.count(x).over(own) >= (least or size), agg.over(own))


def log_return(x: Column, w: WindowSpec, lag: int = 1) -> Column:
    ratio = F.try_divide(x, F.lag(x, lag).over(w))
    return F.when(ratio > 0, F.ln(ratio))


def with_ewma(df: DataFrame, columns: Mapping[str, Column], alpha: float, *keys: str, order: str = "bar_s", start: float | None = None) -> DataFrame:
    """df with the recursion y = (1 - alpha) y + alpha x of each column, seeded with its first value or with `start`; a null leaves y
    as it is. Exact for every alpha in (0, 1], at a constant cost for each row.

    Values are cut into chunks so long that the recursion's factor over one of them is 1e-30. Inside a chunk y is a running sum of
    values over growing powers; what goes on to the next chunk is the end of the one before, and of that before it."""
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must lie in (0, 1]: {alpha}")
    w = series(*keys, order=order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    if alpha == 1:
        return df.withColumns({c: F.coalesce(F.last(x, True).over(upto), *([F.lit(start)] if start is not None else [])) for c, x in columns.items()})
    q = 1.0 - alpha
    size = max(1, int(69.0 / -math.log1p(-alpha)))
    first = F.lit(0.0 if start is None else float(start))
    for i, (name, x) in enumerate(columns.items()):
        v, n, chunk, k, s, e, y = (f"_{c}{i}" for c in ("v", "n", "c", "k", "s", "e", "y"))
        df = df.withColumn(v, x.cast("double")).withColumn(n, F.count(v).over(upto) - 1)
        df = df.withColumns({chunk: F.expr(f"{n} div {size}"), k: F.expr(f"pmod({n}, {size})")})
        seed = F.when(F.col(n) == 0, 1.0).otherwise(alpha) if start is None else F.lit(alpha)
        part = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(s, F.pow(F.lit(q), F.col(k)) * F.sum(F.col(v) * seed * F.pow(F.lit(q), -F.col(k))).over(part))
        full = F.col(v).isNotNull() & (F.col(k) == size - 1)
        df = df.withColumn(e, F.when(full, F.col(s)))
        df = df.withColumn(e, F.when(full, F.col(s) + q**size * F.coalesce(F.last(e, True).over(before), first)))
        df = df.withColumn(y, F.when(F.col(v).isNotNull(), F.col(s) + F.pow(F.lit(q), F.col(k) + 1) * F.coalesce(F.last(e, True).over(before), first)))
        out = F.last(y, True).over(upto)
        df = df.withColumn(name, out if start is None else F.coalesce(out, first)).drop(v, n, chunk, k, s, e, y)
    return df


def with_rsi(df: DataFrame, name: str, delta: str, window: int, *keys: str) -> DataFrame:
    """df with the relative strength from exponentially weighted rises and falls; delta is the column of close's change."""
    d = F.col(delta)
    x = with_ewma(df, {"_up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_down": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))}, 1 / window, *keys)
    return x.withColumn(name, 100 - 100 / (1 + F.col("_up") / (F.col("_down") + 1e-8))).drop("_up", "_down")


def running(agg: Column, w: WindowSpec) -> Column:
    return agg.over(w.rowsBetween(Window.unboundedPreceding, 0))


def drawdown(equity: Column, w: WindowSpec) -> Column:
    return 1 - equity / running(F.max(equity), w)


def gaps(at: Column, w: WindowSpec, step_s: int) -> Column:
    """Seconds since the row before where they aren't step_s, else null."""
    d = at - F.lag(at).over(w)
    return F.when(d != step_s, d)


def forward_fill(x: Column, w: WindowSpec, default: float | None = None) -> Column:
    out = F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out if default is None else F.coalesce(out, F.lit(default))


def back_fill(x: Column, w: WindowSpec) -> Column:
    """The next value; looks ahead, for diagnostics only."""
    return F.first(x, True).over(w.rowsBetween(0, Window.unboundedFollowing))


def stack(obs: Column, w: WindowSpec, size: int) -> Column:
    """The last `size` observation arrays in one, padded in front with the first."""
    seen = F.collect_list(obs).over(w.rowsBetween(-(size - 1), 0))
    return F.flatten(F.concat(F.array_repeat(F.element_at(seen, 1), F.lit(size) - F.size(seen)), seen))
