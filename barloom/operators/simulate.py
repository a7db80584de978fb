"""Allocation simulator: the step ledger of scripted policies as window expressions.

With instant execution a position depends on its own action alone, so costs, funding, profit and equity are lags and running sums
of one ordered pass for each (instrument, policy).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import clip, is_finite, uniform
from barloom.operators import windows as W


@dataclass(frozen=True)
class SimRules:
    fee_bps: float = 2.0
    spread_bps: float = 2.0
    leverage: float = 1.0
    initial: float = 1.0
    start_position: float = 0.0
    ruin: float = 0.15
    beta: float | None = None  # None: instant execution


def actions(df: DataFrame, names: tuple[str, ...] = ("flat", "long", "short", "random"), seed: int = 0) -> DataFrame:
    """Each row once for each policy, with its action in [-1, 1]."""
    known = {"flat": F.lit(0.0), "long": F.lit(1.0), "short": F.lit(-1.0), "random": uniform(F.lit(seed), F.col("instrument"), F.col("bar_s")) * 2 - 1}
    return df.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), known[n].cast("double").alias("action")) for n in names]))).select("*", "_p.policy", "_p.action").drop("_p")


def ledger(df: DataFrame, rules: SimRules = SimRules(), keys: tuple[str, ...] = ("instrument", "policy"), funding: str | None = None) -> DataFrame:
    """The step trace. df: keys, bar_s, close, action. A step runs from a bar to the next, so the last bar has none; steps after ruin
    are cut. ret_fwd, pos_prev, pos, turnover, cost, funding_cost, pnl_gross, pnl_net, equity, drawdown, t_index."""
    w = W.series(*keys)
    x = df.withColumns({"ret_fwd": F.when((F.col("close") > 0) & (F.lead("close").over(w) > 0), F.ln(F.lead("close").over(w) / F.col("close"))), "t_index": F.row_number().over(w) - 1}).where(F.col("ret_fwd").isNotNull())
    x = x.withColumn("target", clip(F.col("action"), -1.0, 1.0) * rules.leverage)
    x = x.withColumn("pos", F.col("target")) if rules.beta is None else W.with_ewma(x, {"pos": F.col("target")}, rules.beta, *keys, start=rules.start_position)
    x = x.withColumn("pos_prev", F.lag("pos", 1, rules.start_position).over(w))
    x = x.withColumn("turnover", F.abs(F.col("pos") - F.col("pos_prev")))
    rate = F.col(funding) if funding else F.lit(0.0)
    x = x.withColumns({"cost": F.col("turnover") * ((rules.fee_bps + rules.spread_bps) / 1e4), "funding_cost": F.col("pos") * F.when(is_finite(rate), rate).otherwise(0.0), "pnl_gross": F.col("pos") * F.col("ret_fwd")})
    x = x.withColumn("pnl_net", F.col("pnl_gross") - F.col("cost") - F.col("funding_cost"))
    x = x.withColumn("equity", rules.initial * F.exp(W.running(F.sum("pnl_net"), w)))
    peak = F.greatest(W.running(F.max("equity"), w), F.lit(rules.initial))
    x = x.withColumn("drawdown", clip(1 - F.col("equity") / peak, 0.0, 1.0))
    broke = F.min(F.when(F.col("equity") <= rules.ruin * rules.initial, F.col("t_index"))).over(Window.partitionBy(*keys))
    return x.withColumn("_end", broke).where(F.col("_end").isNull() | (F.col("t_index") <= F.col("_end"))).drop("_end", "target")


def naive_action(ma: Column, rsi: Column, leverage: float = 1.0) -> Column:
    """Long above the moving average with strength of 50 or more, short below it with 50 or less, else flat."""
    return F.when((ma > 1) & (rsi >= 50), leverage).when((ma < 1) & (rsi <= 50), -leverage).otherwise(0.0)


def centred_action(ma: Column, rsi: Column, leverage: float = 1.0) -> Column:
    """The same for a moving-average ratio that is centred on zero."""
    return naive_action(ma + 1, rsi, leverage)


def anchor_action(ma: Column | None, momentum: Column | None, leverage: float = 1.0) -> Column:
    """Where no strength is known: the sign of the centred moving-average ratio, or else of the momentum; 0 without a finite value."""
    x = ma if ma is not None else momentum
    return F.lit(0.0) if x is None else F.signum(F.coalesce(F.when(is_finite(x), x), F.lit(0.0))) * leverage


def vol_target_position(sigma: Column, target: float, freq: float, leverage: float = 1.0) -> Column:
    """Target volatility over annualised volatility, in [0, leverage]; leverage where no volatility is known."""
    return F.when(sigma > 0, clip(target / (sigma * freq**0.5), 0.0, leverage)).otherwise(leverage)


def first_positive(*columns: Column) -> Column:
    return F.coalesce(*[F.when(is_finite(c) & (c > 0), c) for c in columns])


def hold_equity(df: DataFrame, rules: SimRules = SimRules()) -> DataFrame:
    """Buy-and-hold equity of each instrument's closes, from the first bar on."""
    w = W.series("instrument")
    r = F.coalesce(W.log_return(F.col("close"), w), F.lit(0.0))
    return df.withColumn("log_ret", r).withColumn("equity", rules.initial * F.exp(W.running(F.sum("log_ret"), w)))


def vol_scaled_hold(df: DataFrame, target: float, freq: float) -> DataFrame:
    """Buy and hold scaled by the whole sample's volatility; looks ahead, for comparison only."""
    every = Window.partitionBy("instrument")
    held = hold_equity(df)
    k = clip(F.lit(target) / (F.stddev_pop("log_ret").over(every) * freq**0.5 + 1e-12), 0.0, 3.0)
    return held.withColumn("scale", k).withColumn("equity_vt", F.exp(W.running(F.sum(F.col("log_ret") * F.col("scale")), W.series("instrument"))))


def rewards(trace: DataFrame, dd_threshold: float = 0.1, dd_weight: float = 10.0, dd_power: float = 1.0, smooth: float = 0.001) -> DataFrame:
    """Reward parts of each step: net profit, drawdown hinge and smoothing of the action."""
    w = W.series("instrument", "policy")
    hinge = dd_weight * F.pow(F.greatest(F.lit(0.0), F.col("drawdown") - dd_threshold), F.lit(dd_power)) * F.abs("pos") / 1e4
    change = F.coalesce(F.col("action") - F.lag("action").over(w), F.lit(0.0))
    x = trace.withColumns({"dd_penalty": hinge, "smooth_penalty": -smooth * change * change})
    return x.withColumn("reward", F.col("pnl_net") - F.col("dd_penalty") + F.col("smooth_penalty"))


def observations(trace: DataFrame, features: tuple[str, ...], state: tuple[str, ...] = ("pos_prev", "equity", "drawdown")) -> DataFrame:
    """The observation vector of each step: features, then the simulator's own state."""
    return trace.withColumn("obs", F.array(*[F.col(c).cast("float") for c in (*features, *state)]))


def rollout(df: DataFrame, policy: Callable[[dict], float], features: tuple[str, ...], rules: SimRules = SimRules(), key: str = "instrument") -> DataFrame:
    """A policy that sees its own position and equity, step by step; the only sequential path. One group is one instrument's bars,
    bounded by time range over step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_s")
        pos, equity, peak, out = rules.start_position, rules.initial, rules.initial, []
        import math

        rows = pdf.to_dict("records")
        for a, b in zip(rows, rows[1:]):
            obs = {f: a[f] for f in features} | {"pos_prev": pos, "equity": equity, "drawdown": 1 - equity / peak}
            target = max(-1.0, min(1.0, float(policy(obs)))) * rules.leverage
            cost = abs(target - pos) * (rules.fee_bps + rules.spread_bps) / 1e4
            pos = target
            equity *= math.exp(pos * math.log(b["close"] / a["close"]) - cost)
            peak = max(peak, equity)
            out.append((a[key], a["bar_s"], pos, equity, 1 - equity / peak))
            if equity <= rules.ruin * rules.initial:
                break
        return pd.DataFrame(out, columns=[key, "bar_s", "pos", "equity", "drawdown"]).astype({key: object})

    return df.groupBy(key).applyInPandas(run, f"{key} string, bar_s bigint, pos double, equity double, drawdown double")
