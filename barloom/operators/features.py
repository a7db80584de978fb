"""Causal features of bars, and the forward return that only labels use."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.intervals import bars_of
from barloom.functions.numeric import is_finite
from barloom.operators import windows as W


@dataclass(frozen=True)
class FeatureSpec:
    step_hours: float = 4.0
    vol_hours: float = 24.0
    rsi_window: int = 14
    z_window: int = 100
    fast_hours: float = 24.0
    slow_hours: float = 168.0


FEATURES = ("log_ret_1", "log_ret_24", "vol_roll", "sigma_1h", "rsi", "vol_z", "ma_ratio")
FORWARD = "log_ret_1_fwd"


def check_bars(df: DataFrame) -> dict[str, int]:
    """Counts of rows and of invalid closes and volumes, in one scan."""
    c, v = F.col("close"), F.col("volume")
    return df.agg(F.count("*").alias("rows"), F.count_if(~is_finite(c) | ~(c > 0)).alias("bad_close"), F.count_if(~is_finite(v) | ~(v >= 0)).alias("bad_volume")).first().asDict()


def bar_features(df: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """df with the market features and the forward return of each bar, warm-up and last rows kept."""
    w = W.series("instrument")
    day, vol, fast, slow = (bars_of(h, spec.step_hours, k) for h, k in ((24.0, 1), (spec.vol_hours, 2), (spec.fast_hours, 1), (spec.slow_hours, 2)))
    c, v = F.col("close"), F.col("volume")
    x = df.withColumns({"log_ret_1": W.log_return(c, w), "log_ret_24": W.log_return(c, w, day), "_delta": c - F.lag(c).over(w)})
    r = F.col("log_ret_1")
    x = x.withColumns({
        "vol_roll": W.rolling(F.stddev_samp(r), r, w, vol),
        "vol_z": (v - W.rolling(F.avg(v), v, w, spec.z_window)) / (W.rolling(F.stddev_samp(v), v, w, spec.z_window) + 1e-8),
        "ma_ratio": W.rolling(F.avg(c), c, w, fast) / (W.rolling(F.avg(c), c, w, slow) + 1e-8),
        FORWARD: F.lead(r).over(w),
    }).withColumn("sigma_1h", F.col("vol_roll"))
    return W.with_rsi(x, "rsi", "_delta", spec.rsi_window, "instrument").drop("_delta")


def usable_rows(df: DataFrame, features: tuple[str, ...] = FEATURES, forward: str = FORWARD) -> DataFrame:
    """Rows with all features and a forward value: warm-up and last rows dropped."""
    return df.dropna(subset=list(features)).where(F.col(forward).isNotNull())


def dataset_features(df: DataFrame) -> DataFrame:
    """The bar features of the wide dataset: shape ratios, volume z-score, realised volatility and moving-average ratio."""
    w = W.series("instrument")
    o, h, lo, c = (F.col(k) for k in ("open", "high", "low", "close"))
    x = df.withColumns({"log_ret_1": W.log_return(c, w), "log_ret_24": W.log_return(c, w, 6), "_lv": F.log1p("volume")})
    lv, r = F.col("_lv"), F.col("log_ret_1")
    sd = W.rolling(F.stddev_pop(lv), lv, w, 63, 20)
    return x.withColumns({
        "range_frac": (h - lo) / (F.abs(c) + 1e-12),
        "close_to_high": (h - c) / (h - lo + 1e-12),
        "close_to_low": (c - lo) / (h - lo + 1e-12),
        "volume_z_63": F.try_divide(lv - W.rolling(F.avg(lv), lv, w, 63, 20), F.nullif(sd, F.lit(0.0))),
        "realized_vol_24": W.rolling(F.stddev_pop(r), r, w, 6),
        "ma_ratio_24": c / (W.rolling(F.avg(c), c, w, 6) + 1e-12) - 1,
    }).drop("_lv")


def regime_pack(df: DataFrame) -> DataFrame:
    """Three regime probabilities of each bar from causal scores of trend and volatility, their changes and summaries."""
    w = W.series("instrument")
    r = F.col("log_ret_1")
    x = df.withColumn("log_ret_1", W.log_return(F.col("close"), w)).withColumns({"_t": W.rolling(F.avg(r), r, w, 12), "_s": W.rolling(F.stddev_pop(r), r, w, 12)}).where(F.col("_s").isNotNull())
    z = F.try_divide(F.col("_t"), F.col("_s") + 1e-12)
    x = x.withColumns({"_e0": F.exp(z), "_e1": F.lit(1.0), "_e2": F.exp(-z)})
    total = F.col("_e0") + F.col("_e1") + F.col("_e2")
    x = x.withColumns({f"p_filter_{k}": F.col(f"_e{k}") / total for k in range(3)})
    p = [F.col(f"p_filter_{k}") for k in range(3)]
    top = F.sort_array(F.array(*p), asc=False)
    x = x.withColumns({f"dp_filter_{k}": p[k] - F.lag(p[k]).over(w) for k in range(3)} | {"p_max_filter": F.greatest(*p), "p_margin_filter": top[0] - top[1], "effective_num_states_filter": 1 / sum((q * q for q in p[1:]), p[0] * p[0]), "expected_state_filter": p[1] + 2 * p[2]})
    return x.select("instrument", "bar_s", *[f"p_filter_{k}" for k in range(3)], *[f"dp_filter_{k}" for k in range(3)], "p_max_filter", "p_margin_filter", "effective_num_states_filter", "expected_state_filter")


#: Parts that no feature's name may have, wherever they stand.
FORBIDDEN = ("fwd", "forward", "future", "label", "target", "y_", "ground_truth", "next_", r"t\+1", "reward", "pnl", "equity")


def forbidden_names(names: list[str]) -> list[str]:
    """The names that tell of the future or of results."""
    return [n for n in names if any(re.search(p, n.lower()) for p in FORBIDDEN)]


def numeric_features(df: DataFrame, drop: tuple[str, ...] = ("bar_s",)) -> list[str]:
    """Numeric columns that may be features, in order."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in drop]
    return [n for n in names if n not in forbidden_names(names)]


def regime_columns(names: list[str], with_hat: bool = False) -> list[str]:
    """Regime columns by prefix and name, sorted; raises when there are none."""
    exact = {"p_max_filter", "p_margin_filter", "effective_num_states_filter", "expected_state_filter"} | ({"z_hat_filter"} if with_hat else set())
    found = sorted(n for n in names if n not in ("timestamp", "segment") and (n in exact or re.match(r"d?p_filter_", n)))
    if not found:
        raise ValueError("no regime columns")
    return found
