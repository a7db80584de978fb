"""Metrics of equity curves and of step traces, as aggregates over (keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import is_finite
from barloom.operators import windows as W
from barloom.operators.quantiles import exact_percentiles


def log_steps(df: DataFrame, keys: tuple[str, ...], equity: str = "equity") -> DataFrame:
    """df with r, the change of the logarithm of equity, and dd, the drawdown."""
    w = W.series(*keys)
    return df.withColumns({"r": F.ln(F.col(equity) + 1e-12) - F.lag(F.ln(F.col(equity) + 1e-12)).over(w), "dd": W.drawdown(F.col(equity), w)})


def equity_metrics(df: DataFrame, keys: tuple[str, ...], freq: float, equity: str = "equity") -> DataFrame:
    """Sharpe, volatility, return, drawdown, Sortino, Calmar, moments, tails of each curve; zeros below three points."""
    x = log_steps(df, keys, equity)
    r = F.col("r")
    w = Window.partitionBy(*keys)
    # Two passes over one sort: the quantiles of a curve, then the means beyond them.
    q = F.percentile(r, F.array(*[F.lit(p) for p in (0.01, 0.05, 0.95)])).over(w)
    mean = F.avg(r).over(w)
    x = x.withColumns({"_q": q, "_d": r - mean})
    d = F.col("_d")
    tail = lambda c, cond: F.avg(F.when(cond, c))
    agg = x.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r).alias("mu"), F.stddev_pop(r).alias("sd"), F.max("dd").alias("max_dd"),
        (F.max_by(equity, "bar_s") / F.min_by(equity, "bar_s") - 1).alias("cum_return"),
        F.sqrt(F.avg(F.when(r < 0, r * r))).alias("down"), F.avg(d * d).alias("m2"), F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"),
        F.first(F.col("_q")[0], True).alias("var_99"), F.first(F.col("_q")[1], True).alias("var_95"),
        tail(r, r <= F.col("_q")[0]).alias("cvar_99"), tail(r, r <= F.col("_q")[1]).alias("cvar_95"), tail(r, r >= F.col("_q")[2]).alias("top_95"),
    )
    s = F.sqrt(F.lit(freq))
    ann = F.exp(F.col("mu") * freq) - 1
    out = {
        "sharpe": F.col("mu") / (F.col("sd") + 1e-12) * s, "ann_vol": F.col("sd") * s, "ann_return": ann, "cum_return": F.col("cum_return"), "max_dd": F.col("max_dd"),
        "sortino": F.col("mu") / (F.coalesce("down", F.lit(0.0)) + 1e-12) * s, "calmar": ann / (F.col("max_dd") + 1e-12),
        "skew": F.col("m3") / F.pow(F.col("m2") + 1e-12, F.lit(1.5)), "kurtosis": F.col("m4") / F.pow(F.col("m2") + 1e-12, F.lit(2.0)) - 3,
        "var_95": F.col("var_95"), "cvar_95": F.col("cvar_95"), "var_99": F.col("var_99"), "cvar_99": F.col("cvar_99"),
        "tail_ratio": F.col("top_95") / (F.abs("cvar_95") + 1e-12),
    }
    return agg.select(*keys, "n", *[F.when(F.col("n") < 2, 0.0).otherwise(v).alias(k) for k, v in out.items()])


def north_star(sharpe: Column, max_dd: Column, turnover: Column) -> Column:
    return sharpe - 2 * F.greatest(F.lit(0.0), max_dd - 0.20) - F.greatest(F.lit(0.0), turnover - 0.01)


def monthly(df: DataFrame, keys: tuple[str, ...], freq: float, equity: str = "equity") -> DataFrame:
    """Return, volatility, Sharpe (from five points) and drawdown of each calendar month but the first."""
    x = log_steps(df, keys, equity).withColumn("month", F.date_format(F.timestamp_seconds("bar_s"), "yyyy-MM"))
    x = x.withColumn("dd_m", 1 - F.col(equity) / F.max(equity).over(Window.partitionBy(*keys, "month").orderBy("bar_s").rowsBetween(Window.unboundedPreceding, 0)))
    m = x.groupBy(*keys, "month").agg(F.max_by(equity, "bar_s").alias("_last"), F.stddev_samp("r").alias("_sd"), F.avg("r").alias("_mu"), F.count("r").alias("n"), F.max("dd_m").alias("max_dd"))
    w = Window.partitionBy(*keys).orderBy("month")
    m = m.withColumn("_prev", F.lag("_last").over(w)).where(F.col("_prev").isNotNull())
    return m.select(*keys, "month", (F.col("_last") / F.col("_prev") - 1).alias("return"), (F.col("_sd") * freq**0.5).alias("vol"), F.when(F.col("n") >= 5, F.col("_mu") / (F.col("_sd") + 1e-12) * freq**0.5).alias("sharpe"), "max_dd")


def drawdown_events(df: DataFrame, keys: tuple[str, ...], equity: str = "equity", least: float = 1e-12) -> DataFrame:
    """Each stretch under water: start, trough (the last deepest), recovery (null while open), depth and durations in bars."""
    w = W.series(*keys)
    x = df.withColumns({"dd": W.drawdown(F.col(equity), w), "i": F.row_number().over(w) - 1})
    x = x.withColumn("_island", F.sum((F.col("dd") <= least).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_rec", F.min(F.when(F.col("dd") <= least, F.col("i"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    e = x.where(F.col("dd") > least).groupBy(*keys, "_island").agg(F.min("i").alias("start"), F.max_by("i", F.struct("dd", "i")).alias("trough"), F.first("_rec").alias("recovery"), F.max("dd").alias("depth"), F.max("i").alias("_end"))
    return e.select(*keys, "start", "trough", "recovery", "depth", (F.coalesce("recovery", "_end") - F.col("start")).alias("duration_bars"), (F.col("recovery") - F.col("trough")).alias("recovery_bars"))


def trades(trace: DataFrame, keys: tuple[str, ...], eps: float = 1e-3) -> DataFrame:
    """Directional trades: a run of one sign, left at the first row of the next sign; an open trade is no trade."""
    w = W.series(*keys)
    x = trace.withColumns({"side": F.when(F.col("pos") > eps, 1).when(F.col("pos") < -eps, -1).otherwise(0), "i": F.row_number().over(w) - 1})
    x = x.withColumn("_new", F.coalesce(F.col("side") != F.lag("side").over(w), F.lit(True)).cast("int"))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumns({"_in": F.min("i").over(Window.partitionBy(*keys, "_run")), "_nx": F.lead("equity").over(w)})
    t = x.groupBy(*keys, "_run", "side").agg(F.min("i").alias("entry_i"), F.max("i").alias("_last"), F.min_by("equity", "i").alias("entry_equity"), F.max("equity").alias("_hi"), F.min("equity").alias("_lo"), F.max_by("_nx", "i").alias("exit_equity"))
    t = t.where((F.col("side") != 0) & F.col("exit_equity").isNotNull())
    e0, e1 = F.col("entry_equity"), F.col("exit_equity")
    return t.select(*keys, F.when(F.col("side") > 0, "long").otherwise("short").alias("side"), "entry_i", (F.col("_last") + 1).alias("exit_i"), (F.col("_last") + 2 - F.col("entry_i")).alias("duration_bars"), (e1 - e0).alias("pnl"), (e1 / e0 - 1).alias("return"), (F.greatest("_hi", e1) / e0 - 1).alias("mfe"), (F.least("_lo", e1) / e0 - 1).alias("mae"))


def rebalances(trace: DataFrame, keys: tuple[str, ...], least: float = 0.02) -> DataFrame:
    """Rows whose position moved by at least `least`."""
    d = F.col("pos") - F.col("pos_prev")
    return trace.where(F.abs(d) >= least).select(*keys, "bar_s", F.lit("rebalance").alias("type"), "pos_prev", "pos", d.alias("dpos"))


def trade_stats(t: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    r = F.col("return")
    return t.groupBy(*keys).agg(F.count("*").alias("n_trades"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_return"), F.avg("duration_bars").alias("avg_duration"), (F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)) / (F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0))) + 1e-12)).alias("profit_factor"))


def position_stats(trace: DataFrame, keys: tuple[str, ...], eps: float = 1e-3) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    p = F.col("pos")
    return trace.groupBy(*keys).agg(share(p > eps).alias("pct_long"), share(p < -eps).alias("pct_short"), share(F.abs(p) <= eps).alias("pct_flat"), F.avg("turnover").alias("turnover_mean"), F.avg(F.abs(p)).alias("mean_abs_pos"), F.sum(F.col("turnover") * F.greatest("equity", F.lit(0.0))).alias("notional_turnover"), F.sum("cost").alias("total_cost"), F.sum("funding_cost").alias("total_funding"))


def histogram(df: DataFrame, keys: tuple[str, ...], x: str, bins: int = 80) -> DataFrame:
    """Counts of x in equal bins between its extremes, for each key."""
    w = Window.partitionBy(*keys)
    y = df.where(F.col(x).isNotNull()).withColumns({"_lo": F.min(x).over(w), "_hi": F.max(x).over(w)})
    b = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins))
    return y.groupBy(*keys, F.coalesce(b, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def risk_metrics(df: DataFrame, keys: tuple[str, ...], freq: float, target: float = 0.0, equity: str = "equity") -> DataFrame:
    """The second set of definitions: Sortino against a target return, tail_ratio as the 95 % point over the size of the 5 % point,
    value at risk and the mean beyond it; tails are 0 below ten returns, everything below three points of the curve."""
    x = log_steps(df, keys, equity)
    r = F.col("r")
    q = F.percentile(r, F.array(*[F.lit(p) for p in (0.01, 0.05, 0.95)])).over(Window.partitionBy(*keys))
    below = F.when(r < target, (r - target) * (r - target))
    m = x.withColumn("_q", q).groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r).alias("mu"), (F.stddev_pop(r) + 1e-12).alias("sd"), F.max("dd").alias("max_dd"), F.sqrt(F.avg(below)).alias("down"), F.first("_q", True).alias("_q"),
        F.avg(F.when(r <= F.col("_q")[1], r)).alias("c95"), F.avg(F.when(r <= F.col("_q")[0], r)).alias("c99"),
    )
    s = F.sqrt(F.lit(freq))
    few = lambda c: F.when(F.col("n") < 10, 0.0).otherwise(c)
    out = {"sharpe": F.col("mu") / F.col("sd") * s, "ann_vol": F.col("sd") * s, "sortino": F.col("mu") / (F.coalesce("down", F.lit(0.0)) + 1e-12) * s, "max_dd": F.col("max_dd"), "var_95": few(F.col("_q")[1]), "cvar_95": few(F.col("c95")), "var_99": few(F.col("_q")[0]), "cvar_99": few(F.col("c99")), "tail_ratio": few(F.col("_q")[2] / (F.abs(F.col("_q")[1]) + 1e-12))}
    return m.select(*keys, "n", *[F.when(F.col("n") < 2, 0.0).otherwise(v).alias(k) for k, v in out.items()])


def selection_sharpe(df: DataFrame, key: str, seed: str, value: str) -> DataFrame:
    """(key, config, seed, seed_fold): the Sharpe ratio that each way of selecting runs would report: the median of all runs, the best
    seed's mean, the best single run. Values that aren't finite don't count."""
    x = df.where(is_finite(F.col(value)))
    middle = exact_percentiles(x, [key], F.col(value), (0.5,), ("config",)).select(F.col(key).alias("_key"), "config")
    best = x.groupBy(key, seed).agg(F.avg(value).alias("_m"), F.max(value).alias("_x")).groupBy(key).agg(F.max("_m").alias("seed"), F.max("_x").alias("seed_fold"))
    return best.join(middle, F.col(key).eqNullSafe(F.col("_key"))).select(key, "config", "seed", "seed_fold")


def paired(left: DataFrame, right: DataFrame, keys: tuple[str, ...], value: str, other: str) -> DataFrame:
    """(keys, i, value, other): two curves zipped by position to the shorter one's length."""
    w = W.series(*keys)
    a = left.select(*keys, (F.row_number().over(w) - 1).alias("i"), F.col(value).alias("value"))
    b = right.select(*keys, (F.row_number().over(w) - 1).alias("i"), F.col(other).alias("other"))
    return a.join(b, [*keys, "i"])
