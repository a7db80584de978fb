"""The wide dataset: bar features, funding known at each time, and blocks of columns from slower tables, joined on exact time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import contracts, features, joins

#: The columns of each block of the wide dataset.
MARKET = ("log_ret_1", "log_ret_24", "range_frac", "close_to_high", "close_to_low", "volume_z_63", "realized_vol_24", "ma_ratio_24")
FUNDING = ("funding_rate_1h_scaled",)
REGIME = ("p_max_filter", "p_margin_filter", "effective_num_states_filter", "expected_state_filter", "p_filter_0", "p_filter_1", "p_filter_2", "dp_filter_0", "dp_filter_1", "dp_filter_2")
ALTS = ("alt_eq_ret_4h", "alt_eq_log_ret_24h", "alt_breadth_4h_pos", "alt_breadth_24h_pos", "alt_disp_ret_4h", "alt_eq_vol_logret_24h", "alt_tail_down_share_4h", "alt_frac_crash")
STABLECOINS = ("stab_peg_stress_mean", "stab_peg_stress_max", "stab_tail_intensity", "stab_trust_flow_7d", "stab_activity_volume_z_365d", "stab_effective_n")
MACRO = ("hc_risk_aversion", "hc_risk_aversion_d1", "hc_dollar_tightening", "hc_dollar_tightening_d1", "hc_liquidity_impulse", "hc_liquidity_impulse_d1", "hc_growth_cycle")
#: Names that a funding rate goes by, in the order of preference.
RATES = ("funding_rate", "fundingRate", "rate", "funding")


def wide_dataset(market: DataFrame, funding: DataFrame, blocks: Mapping[str, tuple[DataFrame, Sequence[str]]], at: str = "bar_s") -> DataFrame:
    """instrument, `at`, the market's features, the funding rate and the columns of each block; complete rows only.

    market: bars; funding: instrument, funding_s and a rate under one of the names in RATES. Each block is a table with `at`, the named
    columns and maybe `instrument`; missing columns raise, as does a column that two blocks have. Of rows of a block with one time the one
    with the smallest values counts. Blocks are joined one after the other on exact time, small ones by broadcast as their size
    allows; rows that lack a block or a value, NaN included, are dropped. An empty table gives an empty result.
    """
    rate = contracts.first_existing(funding.columns, RATES)
    if rate is None:
        raise ValueError(f"no funding rate among {funding.columns}")
    rates = funding.select("instrument", "funding_s", F.col(rate).try_cast("double").alias("funding_rate")).where(F.col("funding_rate").isNotNull() & F.col("funding_s").isNotNull())
    x = features.dataset_features(contracts.require_columns(market, ["instrument", at, "open", "high", "low", "close", "volume"]))
    x = joins.attach_funding(x.select("instrument", at, *MARKET), rates)
    names = [*MARKET, *FUNDING]
    for block, (df, columns) in blocks.items():
        keys = [k for k in ("instrument", at) if k in df.columns]
        try:
            own = contracts.require_columns(df, [*keys, *columns])
        except ValueError as e:
            raise ValueError(f"block {block}: {e}") from e
        if twice := set(names) & set(columns):
            raise ValueError(f"block {block} repeats the columns {sorted(twice)}")
        row = F.min(F.struct(*columns)).alias("_row")
        x = x.join(own.groupBy(*keys).agg(row).select(*keys, "_row.*"), keys)
        names += columns
    return x.select("instrument", at, *names).dropna(subset=names)
