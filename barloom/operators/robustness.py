"""Robustness statistics: distributions, block bootstrap, reality checks, stress windows, cost sensitivity, regimes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import is_finite, norm_cdf, uniform
from barloom.operators import windows as W
from barloom.operators.quantiles import exact_percentiles


def distribution(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """mean, std, min, max and exact quantiles of each column, one row for each. Null, NaN and infinite values don't count."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_m")).select("_m.*").where(is_finite(F.col("x")))
    q = exact_percentiles(long, ["metric"], F.col("x"), quantiles, [f"q{round(p * 100):02d}" for p in quantiles]).drop("n")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")).join(q, "metric")


def block_bootstrap(df: DataFrame, key: str, n_boot: int, block: int, seed: int = 0, circular: bool = True) -> DataFrame:
    """(key, boot, step, rn): resampled row numbers of each series in blocks. df: key, n (rows). Starts come from a hash of
    (seed, key, boot, block), so that runs agree anywhere. Non-circular blocks start where they fit."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    x = df.select(key, "n").withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    room = F.col("n") if circular else F.greatest(F.lit(1), F.col("n") - block + 1)
    x = x.withColumn("start", F.floor(uniform(F.lit(seed), F.col(key), F.col("boot"), F.col("b")) * room).cast("bigint"))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("step", F.col("b") * block + F.col("k")).where(F.col("step") < F.col("n"))
    return x.select(key, "boot", "step", F.pmod(F.col("start") + F.col("k"), F.col("n")).alias("rn"))


def bootstrap_metrics(returns: DataFrame, key: str, n_boot: int, block: int, freq: float, seed: int = 0) -> DataFrame:
    """(key, boot, sharpe, cum_return) of resampled series. returns: key, rn, r."""
    sizes = returns.groupBy(key).agg(F.count("*").alias("n"))
    draws = block_bootstrap(sizes, key, n_boot, block, seed).join(returns.select(key, "rn", "r"), [key, "rn"])
    return draws.groupBy(key, "boot").agg((F.avg("r") / (F.stddev_pop("r") + 1e-12) * freq**0.5).alias("sharpe"), (F.exp(F.sum("r")) - 1).alias("cum_return"))


def summarize_bootstrap(boots: DataFrame, key: str, metrics: tuple[str, ...] = ("sharpe", "cum_return"), low: float = 0.05, high: float = 0.95) -> DataFrame:
    return boots.groupBy(key).agg(*[F.percentile(m, F.lit(q)).alias(f"{m}_{n}") for m in metrics for n, q in (("lo", low), ("median", 0.5), ("hi", high))])


def reality_check(excess: DataFrame, key: str, n_boot: int, block: int, seed: int = 0) -> DataFrame:
    """(observed, p_value): the best candidate's mean against the bootstrap of recentred means. excess: key (candidate), rn, r."""
    sizes = excess.groupBy(key).agg(F.count("*").alias("n"), F.avg("r").alias("mu"))
    draws = block_bootstrap(sizes, key, n_boot, block, seed, circular=False).join(excess.select(key, "rn", "r"), [key, "rn"])
    means = draws.groupBy(key, "boot").agg(F.avg("r").alias("m")).join(sizes.select(key, "mu"), key)
    best = means.groupBy("boot").agg(F.max(F.col("m") - F.col("mu")).alias("top"))
    seen = sizes.agg(F.max("mu").alias("observed")).withColumn("_one", F.lit(1))
    return best.withColumn("_one", F.lit(1)).join(F.broadcast(seen), "_one").groupBy("observed").agg(((F.count_if(F.col("top") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p_value"))


def single_reality_check(excess: DataFrame, key: str, n_boot: int, block: int, seed: int = 0) -> DataFrame:
    """(key, n, observed, p_value) of each series by itself: the share of bootstrap means that aren't above zero, not recentred.

    excess: key, rn (0, 1, ..), r. Blocks start anywhere and are cut off at the series' end; they follow each other until as many values as
    the series has are drawn. Series of fewer than max(10, block + 2) values have a null p_value. A block's sum is the difference
    of two running sums, so a draw has a row for each block, not for each value."""
    sums = excess.select(key, "rn", "r", F.sum("r").over(Window.partitionBy(key).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    sizes = sums.groupBy(key).agg(F.count("*").alias("n"), F.avg("r").alias("observed"))
    enough = sizes.where(F.col("n") >= max(10, block + 2))
    # Blocks are cut off at the end now and then; four times as many as whole ones, and some more, always fill the draw.
    x = enough.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / block) * 4 + 16).cast("int"))))
    x = x.withColumn("start", F.floor(uniform(F.lit(seed), F.col(key), F.col("boot"), F.col("b")) * F.col("n")).cast("bigint"))
    x = x.withColumn("len", F.least(F.lit(block), F.col("n") - F.col("start")))
    drawn = F.coalesce(F.sum("len").over(Window.partitionBy(key, "boot").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("len", F.least("len", F.col("n") - drawn)).where("len > 0")
    ends = sums.select(key, F.col("rn").alias("_e"), F.col("upto").alias("_hi"))
    heads = sums.select(key, (F.col("rn") + 1).alias("start"), F.col("upto").alias("_lo"))
    x = x.withColumn("_e", F.col("start") + F.col("len") - 1).join(ends, [key, "_e"]).join(heads, [key, "start"], "left")
    means = x.groupBy(key, "boot", "n").agg((F.sum(F.col("_hi") - F.coalesce("_lo", F.lit(0.0))) / F.col("n")).alias("m"))
    return sizes.join(means.groupBy(key).agg(F.avg((F.col("m") <= 0).cast("double")).alias("p_value")), key, "left")


def deflated_sharpe_columns(sharpe: Column, trials: Column, n_obs: Column, skew: Column, kurtosis: Column) -> dict[str, Column]:
    """deflated_sharpe as columns: sr_star and z; the probability is that of z beyond the normal distribution."""
    n = F.greatest(F.lit(5), n_obs) - 1
    best = F.sqrt(2 * F.ln(F.greatest(F.lit(1), trials).cast("double"))) / F.sqrt(n)
    spread = F.greatest(F.lit(1e-12), 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe)
    return {"sr_star": best, "z": (sharpe - best) * F.sqrt(n) / F.sqrt(spread)}


def deflated_sharpe(sharpe: float, n_trials: int, n_obs: int, skew: float = 0.0, kurtosis: float = 3.0) -> dict[str, float]:
    """The per-period Sharpe ratio against the expected best of n_trials, and the one-sided probability; at least five observations
    and one trial are taken to be there."""
    n = max(5, n_obs) - 1
    best = math.sqrt(2 * math.log(max(1, n_trials))) / math.sqrt(n)
    z = (sharpe - best) * math.sqrt(n) / math.sqrt(max(1e-12, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2))
    return {"sr_star": best, "z": z, "p_value": 1 - norm_cdf(z)}


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) as a column, within 1e-7: the tail series of Abramowitz and Stegun, 26.2.17."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # The coefficients of that series.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def stress_windows(df: DataFrame, key: str, window: int, top: int, equity: str = "equity") -> DataFrame:
    """The worst windows of `window` bars by return and by drawdown inside the window. Windows at the very end are left out, and
    series shorter than window + 5.

    Bars are cut into stretches as long as the window. Each window is the end of a stretch and the head of the next one; its drawdown
    follows from that of both parts, the peak of the first and the trough of the second, all running values, so the cost doesn't
    depend on the window."""
    w = W.series(key)
    x = df.select(key, "bar_s", F.greatest(F.col(equity), F.lit(1e-12)).alias("_e")).withColumns({"rn": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(key))})
    x = x.withColumn("_s", F.expr(f"rn div {window}"))
    up = Window.partitionBy(key, "_s").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key, "_s").orderBy(F.col("rn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    e = F.col("_e")
    x = x.withColumns({"_peak": F.max(e).over(up), "_low": F.min(e).over(up), "_top": F.max(e).over(down), "_least": F.min(e).over(down)})
    x = x.withColumns({"_head": F.max(1 - e / F.col("_peak")).over(up), "_tail": F.max(1 - F.col("_least") / e).over(down)})
    last = lambda c: F.lead(c, window - 1).over(w)
    x = x.withColumns({"_z": last("_e"), "_zlow": last("_low"), "_zhead": last("_head")}).where((F.col("rn") < F.col("n") - window) & (F.col("n") >= window + 5))
    whole = F.expr(f"rn % {window} = 0")
    dd = F.when(whole, F.col("_tail")).otherwise(F.greatest("_tail", "_zhead", 1 - F.col("_zlow") / F.col("_top")))
    x = x.select(key, "rn", (F.col("_z") / e - 1).alias("cum_return"), dd.alias("max_dd"))
    rank = lambda *o: F.row_number().over(Window.partitionBy(key).orderBy(*o, "rn"))
    a = x.withColumn("k", rank(F.col("cum_return"))).where(F.col("k") <= top).withColumn("rank_type", F.lit("cum_return"))
    b = x.withColumn("k", rank(F.col("max_dd").desc())).where(F.col("k") <= top).withColumn("rank_type", F.lit("max_dd"))
    return a.unionByName(b)


def cost_sensitivity(trace: DataFrame, keys: tuple[str, ...], multipliers: tuple[float, ...], freq: float) -> DataFrame:
    """Metrics of each curve with costs taken m times instead of once, recompounded in logs."""
    w = W.series(*keys, "multiplier")
    x = trace.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers]))).withColumn("r", F.col("pnl_net") - (F.col("multiplier") - 1) * F.col("cost"))
    x = x.withColumn("e", F.exp(W.running(F.sum("r"), w)))
    x = x.withColumn("dd", 1 - F.col("e") / F.greatest(W.running(F.max("e"), w), F.lit(1.0)))
    return x.groupBy(*keys, "multiplier").agg((F.avg("r") / (F.stddev_pop("r") + 1e-12) * freq**0.5).alias("sharpe"), (F.exp(F.sum("r")) - 1).alias("cum_return"), F.max("dd").alias("max_dd"))


def regimes(df: DataFrame, key: str, vol_window: int, trend_window: int) -> DataFrame:
    """bull or bear, with high or low volatility, of each bar; head rows take the first known window and the volatility is compared
    with the whole sample's median, so this looks ahead and is for reports only."""
    w = W.series(key)
    r = F.col("log_ret")
    x = df.withColumn("log_ret", W.log_return(F.col("close"), w)).withColumns({"_m": W.rolling(F.avg(r), r, w, trend_window), "_s": W.rolling(F.stddev_samp(r), r, w, vol_window)})
    x = x.withColumns({"_m": W.back_fill(F.col("_m"), w), "_s": W.back_fill(F.col("_s"), w)}).withColumn("_mid", F.percentile("_s", F.lit(0.5)).over(Window.partitionBy(key)))
    label = F.concat(F.when(F.col("_m") >= 0, "bull").otherwise("bear"), F.lit("_"), F.when(F.col("_s") >= F.col("_mid"), "high_vol").otherwise("low_vol"))
    few = F.count("*").over(Window.partitionBy(key)) < max(vol_window, trend_window) + 10
    return x.withColumn("regime", F.when(few, "unknown").when(r.isNull(), "start").otherwise(label)).drop("_m", "_s", "_mid")


def effective_trials(mode: str, configs: int, seeds: int, folds: int) -> int:
    return {"config": configs, "seed": configs * seeds, "seed_fold": configs * seeds * folds}[mode]


def effective_trials_column(mode: str, configs: Column, seeds: Column, runs: Column) -> Column:
    """Trials that count when runs are selected by configuration, by seed or one by one; each factor is at least one."""
    one = F.lit(1)
    return F.greatest(one, configs) * {"config": one, "seed": F.greatest(one, seeds), "seed_fold": F.greatest(one, runs)}[mode]
