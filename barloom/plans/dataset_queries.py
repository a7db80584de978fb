"""Queries of the wide dataset, column contracts, sources and sinks, further metrics and plot tables, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.intervals import bars_of, interval_hours
from barloom.functions.numeric import finite_or_zero, is_finite
from barloom.operators import audit, contracts, dataset, features, joins, metrics, robustness, simulate, splits
from barloom.operators import windows as W
from barloom.plans.reference_queries import _BOOT, _DAYS, _FOLD_ROWS, _FOLDS, _FUND, _KEYS, _LEDGER, _METRICS, _PACK, FEATURES_SQL, FREQ, MARKET, PANEL, W_SQL, _r, _returns, _roll, _trace, registry, rounded
from barloom.session import shared_dir
from barloom.sources import artifacts, bars, timecols
from barloom.sources.tables import table

query, QUERIES, ORACLES = registry()


# --- the wide dataset ----------------------------------------------------------------------------------------------------

def _blocks(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict]:
    """The market's bars, its funding and the four slower tables, each with bar_s: regimes of the market, the cross-section of the panel,
    the panel's closeness to its opens and its activity, and funding levels over the panel."""
    market, panel, w = bars.market_bars(s, d), bars.panel_bars(s, d), W.series("instrument")
    funding = bars.funding_events(s, d)
    regime = features.regime_pack(market)
    x = panel.withColumns({"r1": W.log_return(F.col("close"), w), "r6": W.log_return(F.col("close"), w, 6)})
    share = lambda c: F.avg(c.cast("double"))
    alts = x.groupBy("bar_s").agg(
        F.avg("r1").alias("alt_eq_ret_4h"), F.avg("r6").alias("alt_eq_log_ret_24h"), share(F.col("r1") > 0).alias("alt_breadth_4h_pos"), share(F.col("r6") > 0).alias("alt_breadth_24h_pos"),
        F.stddev_pop("r1").alias("alt_disp_ret_4h"), F.stddev_pop("r6").alias("alt_eq_vol_logret_24h"), share(F.col("r1") < -0.02).alias("alt_tail_down_share_4h"), share(F.col("r6") < -0.1).alias("alt_frac_crash"),
    )
    off = F.abs(F.col("close") / F.col("open") - 1)
    whole = Window.orderBy("bar_s")  # one row for each period, of all instruments
    v = F.col("stab_volume")
    stab = panel.groupBy("bar_s").agg(F.avg(off).alias("stab_peg_stress_mean"), F.max(off).alias("stab_peg_stress_max"), share(off > 0.5).alias("stab_tail_intensity"), F.sum("volume").alias("stab_volume"), F.sum(F.col("volume") * F.col("volume")).alias("_q"))
    stab = stab.withColumns({"stab_trust_flow_7d": W.rolling(F.avg(v), v, whole, 42, 1), "stab_activity_volume_z_365d": (v - W.rolling(F.avg(v), v, whole, 2190, 2)) / (W.rolling(F.stddev_pop(v), v, whole, 2190, 2) + 1e-12), "stab_effective_n": v * v / F.col("_q")})
    level = funding.groupBy(F.col("funding_s").alias("bar_s")).agg(F.max("funding_rate").alias("a"), F.min("funding_rate").alias("b"), F.avg("funding_rate").alias("c"), F.stddev_pop("funding_rate").alias("g"))
    step = lambda c: F.col(c) - F.lag(c).over(whole)
    macro = level.select("bar_s", F.col("a").alias("hc_risk_aversion"), step("a").alias("hc_risk_aversion_d1"), F.col("b").alias("hc_dollar_tightening"), step("b").alias("hc_dollar_tightening_d1"), F.col("c").alias("hc_liquidity_impulse"), step("c").alias("hc_liquidity_impulse_d1"), F.col("g").alias("hc_growth_cycle"))
    rates = funding.groupBy("funding_s").agg(F.avg("funding_rate").alias("fundingRate")).withColumn("instrument", F.lit("ALL"))
    return market, rates, {"regime": (regime, dataset.REGIME), "alts": (alts, dataset.ALTS), "stablecoins": (stab, dataset.STABLECOINS), "macro": (macro, dataset.MACRO)}


_NAMES = (*dataset.MARKET, *dataset.FUNDING, *dataset.REGIME, *dataset.ALTS, *dataset.STABLECOINS, *dataset.MACRO)
_PANEL2 = PANEL.replace("bars AS", "panel AS", 1)
_PACK2 = _PACK.replace("pack AS (SELECT *, p0 - lag(p0) OVER ({W_SQL}) AS dp0".format(W_SQL=W_SQL), "pack AS (SELECT *, p0 - lag(p0) OVER ({W}) AS dp0, p1 - lag(p1) OVER ({W}) AS dp1, p2 - lag(p2) OVER ({W}) AS dp2".format(W=W_SQL))
_WHOLE = "ORDER BY bar_s"


def _digits(name: str) -> int:
    """Rates are small and of few decimals, so they keep more of them; else they lie on rounding boundaries."""
    return 15 if name.startswith(("hc_", "funding_")) else 9



@query(f"""WITH {MARKET}, {_PANEL2}, {_FUND}, {_PACK2},
mk AS (SELECT instrument, bar_s, log_ret_1, log_ret_24, (high - low) / (abs(close) + 1e-12) AS range_frac, (high - close) / (high - low + 1e-12) AS close_to_high, (close - low) / (high - low + 1e-12) AS close_to_low,
  (lv - {_roll('avg', 'lv', 63, 20)}) / nullif({_roll('stddev_pop', 'lv', 63, 20)}, 0) AS volume_z_63, {_roll('stddev_pop', 'log_ret_1', 6)} AS realized_vol_24, close / ({_roll('avg', 'close', 6)} + 1e-12) - 1 AS ma_ratio_24
  FROM (SELECT *, ln(close / lag(close) OVER ({W_SQL})) AS log_ret_1, ln(close / lag(close, 6) OVER ({W_SQL})) AS log_ret_24, ln(1 + volume) AS lv FROM bars)),
fu AS (SELECT funding_s, avg(funding_rate) / 8 AS funding_rate_1h_scaled FROM fund GROUP BY 1), mf AS (SELECT mk.*, funding_rate_1h_scaled FROM mk ASOF LEFT JOIN fu ON mk.bar_s >= fu.funding_s),
rg AS (SELECT bar_s, p_max AS p_max_filter, margin AS p_margin_filter, eff AS effective_num_states_filter, expected AS expected_state_filter, p0 AS p_filter_0, p1 AS p_filter_1, p2 AS p_filter_2, dp0 AS dp_filter_0, dp1 AS dp_filter_1, dp2 AS dp_filter_2 FROM pack),
pr AS (SELECT *, ln(close / lag(close) OVER ({W_SQL})) AS r1, ln(close / lag(close, 6) OVER ({W_SQL})) AS r6, abs(close / open - 1) AS off FROM panel),
al AS (SELECT bar_s, avg(r1) AS alt_eq_ret_4h, avg(r6) AS alt_eq_log_ret_24h, avg(CAST(r1 > 0 AS DOUBLE)) AS alt_breadth_4h_pos, avg(CAST(r6 > 0 AS DOUBLE)) AS alt_breadth_24h_pos, stddev_pop(r1) AS alt_disp_ret_4h, stddev_pop(r6) AS alt_eq_vol_logret_24h, avg(CAST(r1 < -0.02 AS DOUBLE)) AS alt_tail_down_share_4h, avg(CAST(r6 < -0.1 AS DOUBLE)) AS alt_frac_crash FROM pr GROUP BY 1),
s0 AS (SELECT bar_s, avg(off) AS stab_peg_stress_mean, max(off) AS stab_peg_stress_max, avg(CAST(off > 0.5 AS DOUBLE)) AS stab_tail_intensity, sum(volume) AS v, sum(volume * volume) AS q FROM pr GROUP BY 1),
st AS (SELECT *, {_roll('avg', 'v', 42, 1, _WHOLE)} AS stab_trust_flow_7d, (v - {_roll('avg', 'v', 2190, 2, _WHOLE)}) / ({_roll('stddev_pop', 'v', 2190, 2, _WHOLE)} + 1e-12) AS stab_activity_volume_z_365d, v * v / q AS stab_effective_n FROM s0),
m0 AS (SELECT funding_s AS bar_s, max(funding_rate) AS a, min(funding_rate) AS b, avg(funding_rate) AS c, stddev_pop(funding_rate) AS g FROM fund GROUP BY 1),
ma AS (SELECT bar_s, a AS hc_risk_aversion, a - lag(a) OVER ({_WHOLE}) AS hc_risk_aversion_d1, b AS hc_dollar_tightening, b - lag(b) OVER ({_WHOLE}) AS hc_dollar_tightening_d1, c AS hc_liquidity_impulse, c - lag(c) OVER ({_WHOLE}) AS hc_liquidity_impulse_d1, g AS hc_growth_cycle FROM m0),
z AS (SELECT mf.*, rg.* EXCLUDE (bar_s), al.* EXCLUDE (bar_s), st.* EXCLUDE (bar_s, v, q), ma.* EXCLUDE (bar_s) FROM mf JOIN rg ON mf.bar_s = rg.bar_s JOIN al ON mf.bar_s = al.bar_s JOIN st ON mf.bar_s = st.bar_s JOIN ma ON mf.bar_s = ma.bar_s)
SELECT instrument, bar_s, {', '.join(f'round({c}, {_digits(c)}) + 0.0 AS {c}' for c in _NAMES)} FROM z WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _NAMES)}""")
def ref_j7_wide_dataset(s: SparkSession, d: str) -> DataFrame:
    """The wide dataset of forty columns from five tables."""
    x = dataset.wide_dataset(*_blocks(s, d))
    return x.select("instrument", "bar_s", *[(F.round(c, _digits(c)) + 0.0).alias(c) for c in _NAMES])


# --- column contracts ----------------------------------------------------------------------------------------------------

def _list(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


_PACK_COLUMN = "(regexp_matches(column_name, '^d?p_filter_') OR column_name IN ('p_max_filter', 'p_margin_filter', 'effective_num_states_filter', 'expected_state_filter'))"


@query("""SELECT source, count(*) AS n, round(sum(CASE WHEN isfinite(close) THEN close END), 4) + 0.0 AS total FROM features WHERE source IS NOT NULL GROUP BY 1""")
def ref_p03_p04_p16_projection(s: SparkSession, d: str) -> DataFrame:
    """Columns taken in a given order, of which one goes by the first name that is there; missing and repeated ones raise."""
    t = table(s, d, "features")
    key = contracts.first_existing(t.columns, ("instrument", "ticker", "source"))
    x = contracts.require_columns(t, [key, "timestamp", "close"]).where(F.col(key).isNotNull())
    return rounded(x.groupBy(F.col(key).alias("source")).agg(F.count("*").alias("n"), F.sum(F.when(is_finite(F.col("close")), F.col("close"))).alias("total")), 4)


@query(f"SELECT CAST(row_number() OVER (ORDER BY column_name) - 1 AS INT) AS position, column_name FROM (DESCRIBE rl_observation_pack) WHERE {_PACK_COLUMN}")
def ref_p05_regime_columns(s: SparkSession, d: str) -> DataFrame:
    """A pack's regime columns by prefix and name, in order."""
    return _list(s, list(enumerate(features.regime_columns(table(s, d, "rl_observation_pack").columns))), "position int, column_name string")


_MODE_SQL = " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, CAST(row_number() OVER (ORDER BY block, p) - 1 AS INT) AS position, column_name FROM cols WHERE block IN ({', '.join(map(str, blocks))})"
    for mode, blocks in (("market_only", (0, 2)), ("regime_only", (1, 2)), ("market_plus_regime", (0, 1, 2)))
)
_STATE_SQL = ", ".join(f"(2, {i}, '{c}')" for i, c in enumerate(contracts.STATE))


@query(f"""WITH m AS (SELECT 0 AS block, row_number() OVER () AS p, column_name FROM (DESCRIBE train_v1_dataset) WHERE column_name IN ('log_ret_1', 'log_ret_24', 'range_frac', 'close_to_high', 'close_to_low', 'volume_z_63', 'realized_vol_24', 'ma_ratio_24')),
g AS (SELECT 1 AS block, row_number() OVER (ORDER BY column_name) AS p, column_name FROM (DESCRIBE rl_observation_pack) WHERE {_PACK_COLUMN}),
cols AS (SELECT * FROM m UNION ALL SELECT * FROM g UNION ALL SELECT * FROM (VALUES {_STATE_SQL}) t(block, p, column_name)) {_MODE_SQL}""")
def ref_p06_p09_observation_contract(s: SparkSession, d: str) -> DataFrame:
    """The ordered observation columns of each mode: market, regime, the simulator's state; repeated or forbidden names raise."""
    regime = tuple(features.regime_columns(table(s, d, "rl_observation_pack").columns))
    market = tuple(c for c in table(s, d, "train_v1_dataset").columns if c in dataset.MARKET)
    rows = [(mode, i, c) for mode in contracts.MODES for i, c in enumerate(contracts.ObservationContract(mode, market, regime).columns())]
    return _list(s, rows, "mode string, position int, column_name string")


@query("""SELECT t AS table_name, column_name FROM (SELECT 'features' AS t, * FROM (DESCRIBE features) UNION ALL SELECT 'run_walkforward', * FROM (DESCRIBE run_walkforward) UNION ALL SELECT 'train_v1_dataset', * FROM (DESCRIBE train_v1_dataset))
WHERE regexp_matches(column_type, '^(TINYINT|SMALLINT|INTEGER|BIGINT|FLOAT|DOUBLE|DECIMAL)') AND NOT regexp_matches(lower(column_name), 'fwd|forward|future|label|target|y_|ground_truth|next_|t\\+1|reward|pnl|equity')""")
def ref_p07_numeric_features(s: SparkSession, d: str) -> DataFrame:
    """The numeric columns of tables that may be features."""
    rows = [(t, c) for t in ("features", "run_walkforward", "train_v1_dataset") for c in features.numeric_features(table(s, d, t))]
    return _list(s, rows, "table_name string, column_name string")


@query(f"WITH {PANEL}, {FEATURES_SQL} SELECT instrument, count(log_ret_1_fwd) AS n, round(avg(log_ret_1_fwd), 9) + 0.0 AS mean FROM feat GROUP BY 1")
def ref_p08_forward_column(s: SparkSession, d: str) -> DataFrame:
    """The forward return, found by its name."""
    x = features.bar_features(bars.panel_bars(s, d))
    name = contracts.forward_column(x.columns)
    return rounded(x.groupBy("instrument").agg(F.count(name).alias("n"), F.avg(name).alias("mean")), 9)


@query(f"SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY column_name) - 1 AS INT) AS position, column_name FROM (SELECT CASE WHEN {_PACK_COLUMN} THEN 'agent_observable' ELSE 'provenance_only' END AS kind, column_name FROM (DESCRIBE rl_observation_pack))")
def ref_p10_contract_lists(s: SparkSession, d: str) -> DataFrame:
    """The column lists of a pack's contract, as its JSON names them."""
    names = table(s, d, "rl_observation_pack").columns
    agent = features.regime_columns(names)
    written = json.loads(json.dumps({"agent_observable_columns_v1": agent + ["z_hat_filter"], "provenance_only_columns_v1": sorted(set(names) - set(agent))}))
    rows = [(kind, i, c) for kind in ("agent_observable", "provenance_only") for i, c in enumerate(contracts.contract_columns(written, kind))]
    return _list(s, rows, "kind string, position int, column_name string")


_GUARDED = ("features", "content_labels", "train_v1_dataset", "run_walkforward", "supplier", "lineitem")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name FROM (DESCRIBE {t}) WHERE regexp_matches(lower(column_name), 'fwd|forward|future|label|target|y_|ground_truth|next_|t\\+1|reward|pnl|equity')" for t in _GUARDED))
def ref_p11_forbidden_names(s: SparkSession, d: str) -> DataFrame:
    """Names of tables' columns that no feature may have."""
    return _list(s, [(t, c) for t in _GUARDED for c in features.forbidden_names(table(s, d, t).columns)], "table_name string, column_name string")


@query("SELECT row_id, CASE WHEN isfinite(sharpe) THEN sharpe ELSE 0 END + 0.0 AS sharpe, CASE WHEN isfinite(max_dd) THEN max_dd ELSE 0 END + 0.0 AS max_dd FROM run_walkforward")
def ref_p15_finite_or_zero(s: SparkSession, d: str) -> DataFrame:
    """Null, NaN and infinite metrics as 0."""
    return table(s, d, "run_walkforward").select("row_id", *[(finite_or_zero(F.col(c)) + 0.0).alias(c) for c in ("sharpe", "max_dd")])


# --- times ---------------------------------------------------------------------------------------------------------------

@query("""SELECT feed_id, count(*) AS n, min(epoch_us(received_at)) AS first_us, max(epoch_us(received_at)) AS last_us FROM klines_raw WHERE received_at IS NOT NULL AND raw_id % 7 <> 0 GROUP BY 1""")
def ref_t1_parse_utc(s: SparkSession, d: str) -> DataFrame:
    """Texts as UTC times; rows whose text isn't a time are dropped. Every seventh text is made unreadable."""
    text = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    x = table(s, d, "klines_raw").select("feed_id", F.when(F.col("raw_id") % 7 == 0, F.concat(F.lit("at "), text)).otherwise(text).alias("datetime"))
    return timecols.with_timestamp(x).groupBy("feed_id").agg(F.count("*").alias("n"), F.min(F.unix_micros("timestamp")).alias("first_us"), F.max(F.unix_micros("timestamp")).alias("last_us"))


_HOURS = (1.0, 6.0, 10.0, 24.0, 100.0, 168.0)


@query(f"""SELECT DISTINCT bar_step, h AS hours, CAST(greatest(2, round_even(h / CASE bar_step WHEN '30m' THEN 0.5 WHEN '1h' THEN 1.0 WHEN '4h' THEN 4.0 WHEN '8h' THEN 8.0 END, 0)) AS INT) AS bars
FROM rl_observation_pack, (VALUES {', '.join(f'(CAST({h} AS DOUBLE))' for h in _HOURS)}) t(h) WHERE bar_step IN ('30m', '1h', '4h', '8h')""")
def ref_t5_bars_of(s: SparkSession, d: str) -> DataFrame:
    """Bars in so many hours for each step, rounded half to even, at least two."""
    known = {t: interval_hours(t) for t in ("30m", "1h", "4h", "8h")}
    rows = F.array(*[F.struct(F.lit(t).alias("_t"), F.lit(h).alias("hours"), F.lit(bars_of(h, known[t], 2)).alias("bars")) for t in known for h in _HOURS])
    steps = table(s, d, "rl_observation_pack").select("bar_step").distinct()
    return steps.select("bar_step", F.inline(rows)).where(F.col("_t") == F.col("bar_step")).drop("_t")


_REPORTED = ("features", "funding_8h", "orders", "rl_observation_pack", "klines_raw")


@query(f"""WITH c AS ({' UNION ALL '.join(f"SELECT '{t}' AS table_name, column_name FROM (DESCRIBE {t})" for t in _REPORTED)}), k AS (SELECT * FROM (VALUES (0, 'timestamp'), (1, 'datetime'), (2, 'date'), (3, 'time'), (4, 'open_time'), (5, 'received_at'), (6, 'o_orderdate')) t(i, column_name))
SELECT table_name, arg_min(column_name, i) AS time_column FROM c JOIN k USING (column_name) GROUP BY 1""")
def ref_t8_time_column(s: SparkSession, d: str) -> DataFrame:
    """The first column of each table that bears a time's name."""
    names = (*timecols.REPORT_CANDIDATES, "open_time", "received_at", "o_orderdate")
    return _list(s, [(t, timecols.time_column(table(s, d, t).columns, names)) for t in _REPORTED], "table_name string, time_column string")


# --- joins by place and by time ------------------------------------------------------------------------------------------

@query(f"""WITH {PANEL}, {_LEDGER}, a AS (SELECT instrument, equity, row_number() OVER (PARTITION BY instrument ORDER BY bar_s) - 1 AS i FROM led WHERE policy = 'random'),
b AS (SELECT instrument, close, row_number() OVER ({W_SQL}) - 1 AS i FROM bars WHERE volume > 1)
SELECT a.instrument, CAST(a.i AS INT) AS i, {_r('a.equity AS value;b.close AS other')} FROM a JOIN b ON a.instrument = b.instrument AND a.i = b.i""")
def ref_j8_paired_curves(s: SparkSession, d: str) -> DataFrame:
    """Two curves zipped by place to the length of the shorter one."""
    t = _trace(s, d).where(F.col("policy") == "random")
    return rounded(metrics.paired(t, bars.panel_bars(s, d).where("volume > 1"), ("instrument",), "equity", "close"))


@query(f"WITH {PANEL}, {_FUND} SELECT f.instrument, f.funding_s, round(f.funding_rate, 12) + 0.0 AS funding_rate, round(b.close, 6) + 0.0 AS close FROM fund f LEFT JOIN bars b ON f.instrument = b.instrument AND f.funding_s = b.bar_s")
def ref_j9_time_lookup(s: SparkSession, d: str) -> DataFrame:
    """The close at exactly each funding time; keys are checked to be unique."""
    f = bars.funding_events(s, d).withColumn("bar_s", F.col("funding_s"))
    x = joins.exact_join(f, bars.panel_bars(s, d).select("instrument", "bar_s", "close"), ["instrument", "bar_s"], "left")
    return x.select("instrument", "funding_s", (F.round("funding_rate", 12) + 0.0).alias("funding_rate"), (F.round("close", 6) + 0.0).alias("close"))


@query(f"WITH {_DAYS}, {_FOLDS}, {_FOLD_ROWS} SELECT a.instrument, a.fold, count(*) AS n_common FROM fr a JOIN fr b ON a.instrument = b.instrument AND a.bar_s = b.bar_s AND b.fold = a.fold + 1 WHERE a.split = 'train' AND b.split = 'train' GROUP BY 1, 2")
def ref_u2_u4_shared_folds(s: SparkSession, d: str) -> DataFrame:
    """Days that the train rows of a fold and of the next one have in common."""
    rows = splits.walk_forward(bars.daily_bars(s, d)).where(F.col("split") == "train")
    own = rows.groupBy("instrument", "bar_s").agg(F.collect_set("fold").alias("k"))  # at most as many as there are folds
    both = F.filter("k", lambda f: F.array_contains("k", f + 1))
    return own.select("instrument", F.explode(both).alias("fold")).groupBy("instrument", "fold").agg(F.count("*").alias("n_common"))


# --- sources and sinks ---------------------------------------------------------------------------------------------------

def _place(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@query(" UNION ALL ".join(f"SELECT '{k}' AS format, bar_step, count(*) AS n, CAST(sum(bar_id) AS BIGINT) AS ids, round(sum(close), 3) + 0.0 AS total FROM features WHERE isfinite(close) GROUP BY 2" for k in ("parquet", "csv", "json")))
def ref_s2_s7_s8_s13_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Bars written and read again as parquet, csv and json, told by the suffix."""
    x, out = table(s, d, "features").where(is_finite(F.col("close"))).select("bar_id", "bar_step", "close"), None
    for kind in ("parquet", "csv", "json"):
        y = artifacts.read_table(s, artifacts.write_table(x, f"{_place(s, 'bars')}.{kind}"), None if kind == "csv" else x.schema)
        y = y.groupBy(F.lit(kind).alias("format"), "bar_step").agg(F.count("*").alias("n"), F.sum("bar_id").alias("ids"), (F.round(F.sum("close"), 3) + 0.0).alias("total"))
        out = y if out is None else out.unionByName(y)
    return out


@query("""SELECT pack_id, count(DISTINCT (segment, "timestamp")) AS n_rows, 13 AS n_observable FROM rl_observation_pack WHERE "timestamp" IS NOT NULL GROUP BY 1""".replace("13 AS n_observable", f"(SELECT count(*) FROM (DESCRIBE rl_observation_pack) WHERE {_PACK_COLUMN}) AS n_observable"))
def ref_s10_s11_regime_pack(s: SparkSession, d: str) -> DataFrame:
    """A pack's folder with its contract and manifest, read leniently: rows without a time and repeated times are dropped."""
    folder, x = _place(s, "pack"), table(s, d, "rl_observation_pack")
    artifacts.write_table(x, f"{folder}/rl_observation_pack.parquet")
    artifacts.write_json(f"{folder}/feature_contract.json", {"agent_observable_columns_v1": features.regime_columns(x.columns), "forbidden_columns_v1": ["log_ret_1_fwd"]}, spark=s)
    artifacts.write_json(f"{folder}/manifest.json", {"rows": "all"}, spark=s)
    p = artifacts.read_regime_pack(s, folder, strict=False)
    seen = len(contracts.contract_columns(p.contract, "agent_observable"))
    return p.rows.groupBy("pack_id").agg(F.count_distinct(F.struct("segment", "timestamp")).alias("n_rows")).withColumn("n_observable", F.lit(seen).cast("bigint"))


@query("""SELECT fold, round(coalesce(avg(CASE WHEN isfinite(sharpe) THEN sharpe END), 0), 6) + 0.0 AS sharpe, round(coalesce(max(CASE WHEN isfinite(max_dd) THEN max_dd END), 0), 6) + 0.0 AS max_dd, CAST(0 AS DOUBLE) AS sortino FROM run_walkforward GROUP BY 1""")
def ref_s12_flat_metrics(s: SparkSession, d: str) -> DataFrame:
    """Nested metrics as JSON, read as flat rows; what is missing counts as 0."""
    good = lambda c: F.when(is_finite(F.col(c)), F.col(c))
    m = table(s, d, "run_walkforward").groupBy("fold").agg(F.struct(F.struct(F.avg(good("sharpe")).alias("sharpe"), F.max(good("max_dd")).alias("max_dd")).alias("oos")).alias("metrics"))
    x = artifacts.read_table(s, artifacts.write_table(m, f"{_place(s, 'metrics')}.json"), m.schema)
    return rounded(artifacts.flat_metrics(x.withColumn("fold_", F.col("fold").cast("double")), {"_fold": "fold_", "sharpe": "metrics.oos.sharpe", "max_dd": "metrics.oos.max_dd", "sortino": "metrics.oos.sortino"}).select(F.col("_fold").cast("int").alias("fold"), "sharpe", "max_dd", "sortino"))


@query("""SELECT CAST(fold AS VARCHAR) AS run_id, '7' AS seed, printf('%.10g', round(avg(sharpe) FILTER (WHERE isfinite(sharpe)), 4)) AS sharpe_oos, CAST(NULL AS VARCHAR) AS score_val FROM run_walkforward WHERE fold IS NOT NULL GROUP BY fold""")
def ref_s14_run_registry(s: SparkSession, d: str) -> DataFrame:
    """A registry of runs, one row for each fold, appended one by one and read again; unknown keys are ignored."""
    folds = table(s, d, "run_walkforward").where(F.col("fold").isNotNull()).groupBy("fold").agg(F.round(F.avg(F.when(is_finite(F.col("sharpe")), F.col("sharpe"))), 4).alias("m")).collect()  # some folds
    place = f"{_place(s, 'runs')}.csv"
    for r in folds:
        artifacts.append_run(s, place, {"run_id": r.fold, "seed": 7, "sharpe_oos": r.m, "score_val": float("nan"), "colour": "red"})
    if not folds:
        return _list(s, [], "run_id string, seed string, sharpe_oos string, score_val string")
    x = artifacts.read_table(s, place, artifacts.REGISTRY)
    return x.select("run_id", "seed", "sharpe_oos", F.nullif("score_val", F.lit("")).alias("score_val"))


# --- metrics and robustness ----------------------------------------------------------------------------------------------

@query(f"""WITH {PANEL}, {_LEDGER}, {_METRICS}, k AS (SELECT instrument, policy, sqrt(avg((r - 0.001) ** 2) FILTER (WHERE r < 0.001)) AS d FROM r0 GROUP BY 1, 2)
SELECT m.instrument, m.policy, n, {_r("CASE WHEN n < 2 THEN 0 ELSE mu / (sd + 1e-12) * sqrt(2190.0) END AS sharpe;CASE WHEN n < 2 THEN 0 ELSE mu / (coalesce(d, 0) + 1e-12) * sqrt(2190.0) END AS sortino;CASE WHEN n < 10 THEN 0 ELSE q05 END AS var_95;CASE WHEN n < 10 THEN 0 ELSE c05 END AS cvar_95;CASE WHEN n < 10 THEN 0 ELSE q01 END AS var_99;CASE WHEN n < 10 THEN 0 ELSE c01 END AS cvar_99;CASE WHEN n < 10 THEN 0 ELSE q95 / (abs(q05) + 1e-12) END AS tail_ratio", 5)}
FROM m JOIN k ON m.instrument = k.instrument AND m.policy = k.policy JOIN (SELECT instrument, policy, q95 FROM q) q USING (instrument, policy) WHERE m.policy <> 'flat'""".replace("SELECT m.instrument, m.policy, n,", "SELECT instrument, policy, n,").replace("FROM m JOIN k ON m.instrument = k.instrument AND m.policy = k.policy JOIN", "FROM m JOIN k USING (instrument, policy) JOIN").replace("WHERE m.policy <>", "WHERE policy <>"))
def ref_e5_e9_risk_metrics(s: SparkSession, d: str) -> DataFrame:
    """Sortino against a target return, tail ratio of two points, tails of at least ten returns."""
    return rounded(metrics.risk_metrics(_trace(s, d).where(F.col("policy") != "flat"), _KEYS, FREQ, 0.001).drop("ann_vol", "max_dd"), 5)


@query("""WITH u AS (SELECT * FROM run_walkforward WHERE isfinite(sharpe)), g AS (SELECT wf_id, seed, avg(sharpe) AS m, max(sharpe) AS x FROM u GROUP BY 1, 2), q AS (SELECT wf_id, quantile_cont(sharpe, 0.5) AS c FROM u GROUP BY 1)
SELECT g.wf_id, round(any_value(c), 6) + 0.0 AS config, round(max(m), 6) + 0.0 AS seed, round(max(x), 6) + 0.0 AS seed_fold FROM g JOIN q ON g.wf_id IS NOT DISTINCT FROM q.wf_id GROUP BY 1""")
def ref_a7_selection_modes(s: SparkSession, d: str) -> DataFrame:
    """The Sharpe ratio that each way of selecting runs would report, for each walk-forward."""
    return rounded(metrics.selection_sharpe(table(s, d, "run_walkforward"), "wf_id", "seed", "sharpe"))


@query("""SELECT wf_id, CAST(3 AS BIGINT) AS config, CAST(3 * greatest(1, count(DISTINCT seed)) AS BIGINT) AS seed, CAST(3 * greatest(1, count(*)) AS BIGINT) AS seed_fold FROM run_walkforward GROUP BY 1""")
def ref_r11_effective_trials(s: SparkSession, d: str) -> DataFrame:
    """Trials that count in each way of selecting runs, for three configurations."""
    n = table(s, d, "run_walkforward").groupBy("wf_id").agg(F.count_distinct("seed").alias("seeds"), F.count("*").alias("runs"))
    return n.select("wf_id", *[robustness.effective_trials_column(m, F.lit(3), F.col("seeds"), F.col("runs")).cast("bigint").alias(m) for m in ("config", "seed", "seed_fold")])


@query(f"""WITH {PANEL}, {FEATURES_SQL} SELECT instrument, bar_s, CAST(CASE WHEN ma_ratio - 1 > 0 AND rsi >= 50 THEN 1 WHEN ma_ratio - 1 < 0 AND rsi <= 50 THEN -1 ELSE 0 END AS DOUBLE) AS centred,
CAST(coalesce(sign(ma_ratio - 1), 0) AS DOUBLE) AS by_average, CAST(coalesce(sign(log_ret_24), 0) AS DOUBLE) AS by_momentum FROM feat""")
def ref_m13_rule_variants(s: SparkSession, d: str) -> DataFrame:
    """The naive rule for a ratio centred on zero, and what stands in where no strength is known."""
    f = features.bar_features(bars.panel_bars(s, d)).withColumn("_ma", F.col("ma_ratio") - 1)
    return f.select("instrument", "bar_s", simulate.centred_action(F.col("_ma"), F.col("rsi")).alias("centred"), (simulate.anchor_action(F.col("_ma"), None) + 0.0).alias("by_average"), (simulate.anchor_action(None, F.col("log_ret_24")) + 0.0).alias("by_momentum"))


@query(f"""WITH {PANEL}, {_BOOT.split('sz AS')[0]} cum AS (SELECT instrument, rn, r, sum(r) OVER (PARTITION BY instrument ORDER BY rn) AS upto FROM ret), sz AS (SELECT instrument, count(*) AS n, avg(r) AS observed FROM ret GROUP BY 1),
dr AS (SELECT instrument, n, boot, b, CAST(floor(CAST(('0x' || substr(md5('0|' || instrument || '|' || boot || '|' || b), 1, 8)) AS BIGINT) / 4294967296.0 * n) AS BIGINT) AS start FROM sz, range(2000) t(boot), range(2000) u(b) WHERE n >= 50 AND b <= ceil(n / 48.0) * 4 + 16),
le AS (SELECT *, least(48, n - start) AS len FROM dr), cu AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY instrument, boot ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM le),
bl AS (SELECT instrument, n, boot, start, least(len, n - had) AS len FROM cu WHERE n - had > 0),
me AS (SELECT bl.instrument, boot, sum(z.upto - coalesce(a.upto, 0)) / any_value(n) AS m FROM bl JOIN cum z ON bl.instrument = z.instrument AND bl.start + bl.len - 1 = z.rn LEFT JOIN cum a ON bl.instrument = a.instrument AND bl.start = a.rn + 1 GROUP BY 1, 2),
pv AS (SELECT instrument, avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END) AS p FROM me GROUP BY 1)
SELECT sz.instrument, n, round(observed, 9) + 0.0 AS observed, round(p, 6) + 0.0 AS p_value FROM sz LEFT JOIN pv ON sz.instrument = pv.instrument""".replace("{room}", "n").replace("{boots}", "2000").replace("{block}", "48"))
def ref_r8_single_reality_check(s: SparkSession, d: str) -> DataFrame:
    """Each instrument's mean return against zero: 2 000 draws of blocks of 48 that end with the series, not recentred."""
    x = robustness.single_reality_check(_returns(s, d), "instrument", 2000, 48)
    return x.select("instrument", "n", (F.round("observed", 9) + 0.0).alias("observed"), (F.round("p_value", 6) + 0.0).alias("p_value"))


# --- reports of tables ---------------------------------------------------------------------------------------------------

@query(f"""WITH c AS (SELECT row_number() OVER () - 1 AS position, column_name, column_type FROM (DESCRIBE rl_observation_pack)),
n AS (SELECT column_name, count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL) AS n_null FROM (SELECT COLUMNS(*)::VARCHAR FROM rl_observation_pack) UNPIVOT INCLUDE NULLS (v FOR column_name IN (*)) GROUP BY 1)
SELECT CAST(position AS INT) AS position, column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' WHEN 'TIMESTAMP' THEN 'timestamp' ELSE lower(column_type) END AS type, n_rows, n_null FROM c JOIN n USING (column_name)""")
def ref_x3_frame_report(s: SparkSession, d: str) -> DataFrame:
    """Place, name, type, rows and nulls of each column."""
    x = audit.frame_report(table(s, d, "rl_observation_pack"))
    return x.withColumn("type", F.regexp_replace("type", "^timestamp_ntz$", "timestamp"))


@query("""SELECT 'pack_id' AS column_name, pack_id AS value, count(*) AS n FROM rl_observation_pack GROUP BY 2 UNION ALL SELECT 'segment', segment, count(*) FROM rl_observation_pack GROUP BY 2 UNION ALL SELECT 'bar_step', bar_step, count(*) FROM rl_observation_pack GROUP BY 2""")
def ref_x5_value_counts(s: SparkSession, d: str) -> DataFrame:
    """How often each pack, segment and step occurs."""
    return audit.value_counts(table(s, d, "rl_observation_pack"), ["pack_id", "segment", "bar_step"])


# --- plot tables ---------------------------------------------------------------------------------------------------------

_HELD = f"""h0 AS (SELECT instrument, bar_s, coalesce(ln(close / lag(close) OVER ({W_SQL})), 0) AS lr FROM bars), hold AS (SELECT instrument, bar_s, lr, exp(sum(lr) OVER ({W_SQL})) AS equity FROM h0)"""


@query(f"""WITH {PANEL}, {_LEDGER}, {_HELD}, x AS (SELECT l.instrument, l.bar_s, l.pos, l.turnover, l.equity, h.equity AS hold FROM led l JOIN hold h ON l.instrument = h.instrument AND l.bar_s = h.bar_s WHERE policy = 'random')
SELECT instrument, bar_s, {_r(f'equity;hold;pos AS position;turnover;1 - equity / max(equity) OVER ({W_SQL}) AS drawdown;equity / max(equity) OVER ({W_SQL}) - 1 AS underwater;sum(turnover) OVER ({W_SQL}) AS cum_turnover')} FROM x""")
def ref_e22_curves(s: SparkSession, d: str) -> DataFrame:
    """The data of the curves over time: equity, buy and hold, position, turnover, drawdown and the share under water."""
    w = W.series("instrument")
    held = simulate.hold_equity(bars.panel_bars(s, d)).select("instrument", "bar_s", F.col("equity").alias("hold"))
    x = _trace(s, d).where(F.col("policy") == "random").join(held, ["instrument", "bar_s"])
    dd = W.drawdown(F.col("equity"), w)
    return rounded(x.select("instrument", "bar_s", "equity", "hold", F.col("pos").alias("position"), "turnover", dd.alias("drawdown"), (-dd).alias("underwater"), W.running(F.sum("turnover"), w).alias("cum_turnover")))


def _histogram_sql(source: str, x: str) -> str:
    return f"""l AS (SELECT instrument, {x} AS v, min({x}) OVER (PARTITION BY instrument) AS lo, max({x}) OVER (PARTITION BY instrument) AS hi FROM {source} WHERE {x} IS NOT NULL)
SELECT instrument, CAST(coalesce(least(79, floor((v - lo) / nullif(hi - lo, 0) * 80)), 0) AS INT) AS bin, count(*) AS n FROM l GROUP BY 1, 2"""


@query(f"WITH {PANEL}, {_LEDGER}, pz AS (SELECT instrument, pos FROM led WHERE policy = 'random'), {_histogram_sql('pz', 'pos')}")
def ref_e22_exposure_histogram(s: SparkSession, d: str) -> DataFrame:
    """Positions in eighty bins."""
    return metrics.histogram(_trace(s, d).where(F.col("policy") == "random"), ("instrument",), "pos")


@query(f"WITH {PANEL}, rz AS (SELECT instrument, round(ln(close / lag(close) OVER ({W_SQL})), 12) AS r FROM bars), {_histogram_sql('rz', 'r')}")
def ref_e22_returns_histogram(s: SparkSession, d: str) -> DataFrame:
    """Returns in eighty bins."""
    return metrics.histogram(bars.panel_bars(s, d).withColumn("r", F.round(W.log_return(F.col("close"), W.series("instrument")), 12)), ("instrument",), "r")


@query(f"""WITH {PANEL}, {_LEDGER}, {_HELD} SELECT l.instrument, l.bar_s, round(l.pnl_net, 8) + 0.0 AS own, round(h.lr, 8) + 0.0 AS benchmark FROM (SELECT * FROM led WHERE policy = 'random') l JOIN hold h ON l.instrument = h.instrument AND l.bar_s = h.bar_s""")
def ref_e22_scatter(s: SparkSession, d: str) -> DataFrame:
    """A policy's return of each bar beside the benchmark's."""
    held = simulate.hold_equity(bars.panel_bars(s, d)).select("instrument", "bar_s", F.col("log_ret").alias("benchmark"))
    x = _trace(s, d).where(F.col("policy") == "random").join(held, ["instrument", "bar_s"])
    return rounded(x.select("instrument", "bar_s", F.col("pnl_net").alias("own"), "benchmark"), 8)


@query(f"""WITH {PANEL}, {_BOOT.format(room='n', boots=500, block=48)}, bm AS (SELECT ix.instrument, boot, exp(sum(r)) - 1 AS c FROM ix JOIN ret ON ix.instrument = ret.instrument AND ix.rn = ret.rn GROUP BY 1, 2)
SELECT instrument, CAST(i AS INT) AS i, round(c, 6) + 0.0 AS cum_return FROM (SELECT instrument, unnest(range(19)) AS i, unnest(quantile_cont(c, {[round((i + 1) / 20, 2) for i in range(19)]})) AS c FROM bm GROUP BY 1)""")
def ref_e22_bootstrap_fan(s: SparkSession, d: str) -> DataFrame:
    """Nineteen quantiles of the bootstrap's returns."""
    b = robustness.bootstrap_metrics(_returns(s, d), "instrument", 500, 48, FREQ)
    q = b.groupBy("instrument").agg(F.percentile("cum_return", F.array(*[F.lit(round((i + 1) / 20, 2)) for i in range(19)])).alias("_q"))
    return rounded(q.select("instrument", F.posexplode("_q").alias("i", "cum_return")))
