"""Queries of the analytics operators on bars, and the SQL that states the same results.

Bars come from `events` (a panel by event_type, or one market) and `orders` (daily, by priority). Times are seconds since 1970.
"""

from __future__ import annotations

import math


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import is_finite, norm_ppf, safe_float
from barloom.operators import audit, features, joins, metrics, robustness, simulate, splits
from barloom.operators import windows as W
from barloom.operators.quantiles import exact_percentiles
from barloom.sources import bars, timecols
from barloom.sources.tables import table

STEP = 14_400
FREQ = 6 * 365.0
DAY_FREQ = 365.0


def registry():
    """A decorator that names a query, with its SQL, and the two tables it fills."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, name: str | None = None):
        def add(f):
            queries[name or f.__name__] = f
            if sql:
                oracles[name or f.__name__] = sql
            return f

        return add

    return query, queries, oracles


query, QUERIES, ORACLES = registry()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and freed of negative zero, so that sums in another order compare equal."""
    return df.select(*[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


# --- SQL building blocks -------------------------------------------------------------------------------------------------

def _bars_sql(name: str, source: str, instrument: str, ts: str, value: str, order: str, step: int) -> str:
    return f"""{name} AS (SELECT {instrument} AS instrument, CAST(floor(epoch({ts}) / {step}) * {step} AS BIGINT) AS bar_s,
  first({value} ORDER BY {ts}, {order}) AS open, max({value}) AS high, min({value}) AS low, last({value} ORDER BY {ts}, {order}) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM {source} WHERE {value} > 0 AND isfinite({value}) AND {ts} IS NOT NULL GROUP BY 1, 2)"""


PANEL = _bars_sql("bars", "events", "event_type", "ts", "value", "event_id", STEP)
HOURLY = _bars_sql("bars", "events", "event_type", "ts", "value", "event_id", 3600)
MARKET = _bars_sql("bars", "events", "'ALL'", "ts", "value", "event_id", STEP)
DAILY = _bars_sql("bars", "orders", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", 86_400)
W_SQL = "PARTITION BY instrument ORDER BY bar_s"


def _roll(f: str, x: str, size: int, least: int | None = None, part: str = W_SQL) -> str:
    o = f"OVER ({part} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {o} >= {least or size} THEN {f}({x}) {o} END"


def _ewma(x: str, alpha: float) -> str:
    return f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER ({W_SQL} ROWS UNBOUNDED PRECEDING), lambda y, v: y * (1 - {alpha!r}) + v * {alpha!r})"


FEATURES_SQL = f"""f1 AS (SELECT *, ln(close / lag(close) OVER ({W_SQL})) AS log_ret_1, ln(close / lag(close, 6) OVER ({W_SQL})) AS log_ret_24, close - lag(close) OVER ({W_SQL}) AS delta FROM bars),
f2 AS (SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS up, CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END AS dn FROM f1),
feat AS (SELECT instrument, bar_s, open, high, low, close, volume, log_ret_1, log_ret_24, {_roll('stddev_samp', 'log_ret_1', 6)} AS vol_roll,
  100 - 100 / (1 + {_ewma('up', 1 / 14)} / ({_ewma('dn', 1 / 14)} + 1e-8)) AS rsi,
  (volume - {_roll('avg', 'volume', 100)}) / ({_roll('stddev_samp', 'volume', 100)} + 1e-8) AS vol_z,
  {_roll('avg', 'close', 6)} / ({_roll('avg', 'close', 42)} + 1e-8) AS ma_ratio,
  lead(log_ret_1) OVER ({W_SQL}) AS log_ret_1_fwd FROM f2)"""


def _r(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c.rsplit(' AS ', 1)[0].strip()}, {digits}) + 0.0 AS {c.rsplit(' AS ', 1)[-1].strip()}" for c in cols.split(";"))


# --- sources and contracts -----------------------------------------------------------------------------------------------

@query(f"""WITH c AS (SELECT source AS instrument, epoch_us("timestamp") AS us, open, high, low, close, volume, row_number() OVER (PARTITION BY source, "timestamp" ORDER BY bar_id) AS k
  FROM features WHERE isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND isfinite(volume) AND "timestamp" IS NOT NULL AND source IS NOT NULL)
SELECT instrument, us, {_r('open;high;low;close;volume', 8)} FROM c WHERE k = 1""")
def ref_s1_load_ohlcv(s: SparkSession, d: str) -> DataFrame:
    """Finite OHLCV rows, one for each source and time."""
    return rounded(bars.load_ohlcv(table(s, d, "features"), "source", "timestamp", "bar_id"), 8)


@query()
def ref_s5_klines_to_ohlcv(s: SparkSession, d: str) -> DataFrame:
    """Raw text klines as clean OHLCV rows, their times read by the timestamp cascade."""
    from barloom.operators.timestamps import normalize_timestamps

    raw = normalize_timestamps(table(s, d, "klines_raw"), table(s, d, "feeds"), {"open_time": None})
    return rounded(bars.klines_to_ohlcv(raw, F.col("open_time_instant.utc_us"), "feed_id"), 8)


@query(f"WITH {PANEL} SELECT instrument, bar_s, {_r('open;high;low;close;volume', 8)} FROM bars")
def ref_bars_panel(s: SparkSession, d: str) -> DataFrame:
    return rounded(bars.panel_bars(s, d), 8)


@query(f"WITH {DAILY} SELECT instrument, bar_s, {_r('open;high;low;close;volume', 8)} FROM bars")
def ref_bars_daily(s: SparkSession, d: str) -> DataFrame:
    return rounded(bars.daily_bars(s, d), 8)


_UNITS = (("ms", 1_000), ("s", 1_000_000), ("ns", 1))


@query(" UNION ALL ".join(f"""SELECT '{u}' AS written, event_type, min(epoch_us(ts) // {k if u != 'ns' else 1} * {k if u != 'ns' else 1} // 1000000) AS first_s,
  (SELECT CASE WHEN median(n) > 1e14 THEN 'ns' WHEN median(n) > 1e11 THEN 'ms' WHEN median(n) > 1e9 THEN 's' ELSE 'ns' END FROM (SELECT CAST(epoch_us(ts) {'// ' + str(k) if u != 'ns' else '* 1000'} AS DOUBLE) AS n FROM events WHERE ts IS NOT NULL)) AS unit
  FROM events WHERE ts IS NOT NULL GROUP BY 2""" for u, k in _UNITS))
def ref_t2_epoch_unit(s: SparkSession, d: str) -> DataFrame:
    """Epoch numbers in milliseconds, seconds and nanoseconds, whose unit follows from their median."""
    out = None
    for unit, k in _UNITS:
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        x = table(s, d, "events").where(F.col("ts").isNotNull()).select("event_type", (us * 1000 if unit == "ns" else F.floor(us / k)).alias("fundingTime"))
        told = timecols.epoch_unit(x.agg(F.percentile_approx(F.col("fundingTime").cast("double"), 0.5)).first()[0])
        y = timecols.with_timestamp(x).groupBy("event_type").agg(F.min(F.unix_seconds("timestamp")).alias("first_s")).select(F.lit(unit).alias("written"), "event_type", "first_s", F.lit(told).alias("unit"))
        out = y if out is None else out.unionByName(y)
    return out


@query("""SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS first_iso, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2""")
def ref_t6_t7_calendar(s: SparkSession, d: str) -> DataFrame:
    """Year and month slices with ISO-8601 rendering of the first time."""
    o = table(s, d, "orders").where(F.col("o_orderdate").isNotNull())
    return o.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_iso"), F.count("*").alias("n"))


@query(f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE close IS NULL OR NOT isfinite(close) OR close <= 0) AS bad_close, count(*) FILTER (WHERE volume IS NULL OR NOT isfinite(volume) OR volume < 0) AS bad_volume FROM features""")
def ref_p02_validity(s: SparkSession, d: str) -> DataFrame:
    """Counts of closes and volumes that no feature may be built from."""
    c, v = F.col("close"), F.col("volume")
    return table(s, d, "features").agg(F.count("*").alias("n_rows"), F.count_if(~is_finite(c) | ~(c > 0)).alias("bad_close"), F.count_if(~is_finite(v) | ~(v >= 0)).alias("bad_volume"))


@query(f"""WITH {PANEL}, lim AS (SELECT min(bar_s) + 864000 AS lo, max(bar_s) - 864000 AS hi FROM bars) SELECT instrument, count(*) AS n, min(bar_s) AS first_s, max(bar_s) AS last_s FROM bars, lim WHERE bar_s BETWEEN lo AND hi GROUP BY 1""")
def ref_p12_trim_to_support(s: SparkSession, d: str) -> DataFrame:
    """Bars within the range another table covers."""
    b = bars.panel_bars(s, d)
    span = b.agg((F.min("bar_s") + 864000).alias("lo"), (F.max("bar_s") - 864000).alias("hi"))
    other = span.select(F.explode(F.array("lo", "hi")).alias("bar_s"))
    return joins.trim_to_support(b, other, "bar_s").groupBy("instrument").agg(F.count("*").alias("n"), F.min("bar_s").alias("first_s"), F.max("bar_s").alias("last_s"))


@query("""SELECT raw_id, coalesce(CASE WHEN isfinite(TRY_CAST(trim(fundingRate) AS DOUBLE)) THEN TRY_CAST(trim(fundingRate) AS DOUBLE) END, 0.0) AS rate FROM funding_raw""")
def ref_p17_safe_float(s: SparkSession, d: str) -> DataFrame:
    """Texts as finite numbers, 0 where they aren't."""
    return table(s, d, "funding_raw").select("raw_id", safe_float(F.col("fundingRate")).alias("rate"))


# --- features ------------------------------------------------------------------------------------------------------------

_FEATURE_COLS = "log_ret_1;log_ret_24;vol_roll;vol_roll AS sigma_1h;rsi;vol_z;ma_ratio;log_ret_1_fwd"
_FEATURES = ("log_ret_1", "log_ret_24", "vol_roll", "sigma_1h", "rsi", "vol_z", "ma_ratio", "log_ret_1_fwd")


@query(f"WITH {MARKET}, {FEATURES_SQL} SELECT instrument, bar_s, {_r(_FEATURE_COLS)} FROM feat WHERE log_ret_1 IS NOT NULL AND log_ret_24 IS NOT NULL AND vol_roll IS NOT NULL AND rsi IS NOT NULL AND vol_z IS NOT NULL AND ma_ratio IS NOT NULL AND log_ret_1_fwd IS NOT NULL")
def flagship_features(s: SparkSession, d: str) -> DataFrame:
    """The market's causal features: returns, volatility, strength, volume score, moving averages and the forward return."""
    return rounded(features.usable_rows(features.bar_features(bars.market_bars(s, d))).select("instrument", "bar_s", *_FEATURES))


@query(f"WITH {PANEL}, {FEATURES_SQL} SELECT instrument, bar_s, {_r(_FEATURE_COLS)} FROM feat")
def ref_w01_w10_features(s: SparkSession, d: str) -> DataFrame:
    """The same for each instrument of the panel, warm-up rows kept."""
    return rounded(features.bar_features(bars.panel_bars(s, d)).select("instrument", "bar_s", *_FEATURES))


_DATASET = f"""d1 AS (SELECT *, ln(close / lag(close) OVER ({W_SQL})) AS log_ret_1, ln(close / lag(close, 6) OVER ({W_SQL})) AS log_ret_24, ln(1 + volume) AS lv FROM bars)
SELECT instrument, bar_s, {{}} FROM (SELECT instrument, bar_s, log_ret_1, log_ret_24, (high - low) / (abs(close) + 1e-12) AS range_frac, (high - close) / (high - low + 1e-12) AS close_to_high, (close - low) / (high - low + 1e-12) AS close_to_low,
 (lv - {_roll('avg', 'lv', 63, 20)}) / nullif({_roll('stddev_pop', 'lv', 63, 20)}, 0) AS volume_z_63, {_roll('stddev_pop', 'log_ret_1', 6)} AS realized_vol_24, close / ({_roll('avg', 'close', 6)} + 1e-12) - 1 AS ma_ratio_24 FROM d1)"""
_DATASET_COLS = ("log_ret_1", "log_ret_24", "range_frac", "close_to_high", "close_to_low", "volume_z_63", "realized_vol_24", "ma_ratio_24")


@query(f"WITH {PANEL}, " + _DATASET.format(_r(";".join(_DATASET_COLS))))
def ref_w04_w06_f03_dataset_features(s: SparkSession, d: str) -> DataFrame:
    """The wide dataset's bar features."""
    return rounded(features.dataset_features(bars.panel_bars(s, d)).select("instrument", "bar_s", *_DATASET_COLS))


@query(f"WITH {HOURLY}, g AS (SELECT instrument, bar_s, bar_s - lag(bar_s) OVER ({W_SQL}) AS gap_s FROM bars) SELECT * FROM g WHERE gap_s <> 3600")
def ref_w09_gaps(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars that don't follow the one before by an hour."""
    return audit.gap_rows(bars.panel_bars(s, d, 3600), "instrument", "bar_s", 3600)


@query(f"""WITH {PANEL}, l AS (SELECT instrument, bar_s, coalesce(ln(close / lag(close) OVER ({W_SQL})), 0) AS r FROM bars),
e AS (SELECT *, exp(sum(r) OVER ({W_SQL})) AS equity FROM l)
SELECT instrument, bar_s, {_r('equity;1 - equity / max(equity) OVER (PARTITION BY instrument ORDER BY bar_s) AS drawdown')} FROM e""")
def ref_w11_w12_equity(s: SparkSession, d: str) -> DataFrame:
    """Buy-and-hold equity and its drawdown."""
    h = simulate.hold_equity(bars.panel_bars(s, d))
    return rounded(h.select("instrument", "bar_s", "equity", W.drawdown(F.col("equity"), W.series("instrument")).alias("drawdown")))


@query(f"""WITH {PANEL}, l AS (SELECT instrument, bar_s, ln(close / lag(close) OVER ({W_SQL})) AS r FROM bars)
SELECT instrument, bar_s, {_r(f"({_roll('avg', 'r', 30)}) / (({_roll('stddev_pop', 'r', 30)}) + 1e-12) * sqrt(2190.0) AS rolling_sharpe;({_roll('stddev_pop', 'r', 30)}) * sqrt(2190.0) AS rolling_vol")} FROM l""")
def ref_w14_w15_rolling(s: SparkSession, d: str) -> DataFrame:
    """Rolling Sharpe ratio and volatility."""
    w, r = W.series("instrument"), F.col("r")
    x = bars.panel_bars(s, d).withColumn("r", W.log_return(F.col("close"), w))
    sd = W.rolling(F.stddev_pop(r), r, w, 30)
    return rounded(x.select("instrument", "bar_s", (W.rolling(F.avg(r), r, w, 30) / (sd + 1e-12) * math.sqrt(FREQ)).alias("rolling_sharpe"), (sd * math.sqrt(FREQ)).alias("rolling_vol")))


@query(f"""WITH {PANEL}, o AS (SELECT instrument, bar_s, row_number() OVER ({W_SQL}) AS rn, close, list(close) OVER ({W_SQL} ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) AS l FROM bars)
SELECT instrument, bar_s, round(l[greatest(1, len(l) - 63)], 6) + 0.0 AS first_obs, round(l[-1], 6) + 0.0 AS last_obs, round(list_sum(l) + (64 - len(l)) * l[1], 5) + 0.0 AS sum_obs, CAST(len(l) + (64 - len(l)) AS INT) AS n_obs FROM o""")
def ref_w18_window_stack(s: SparkSession, d: str) -> DataFrame:
    """Sixty-four observations stacked, padded in front with the first."""
    w = W.series("instrument")
    x = bars.panel_bars(s, d).withColumn("_o", F.array("close")).withColumn("_s", W.stack(F.col("_o"), w, 64))
    return rounded(x.select("instrument", "bar_s", F.element_at("_s", 1).alias("first_obs"), F.element_at("_s", -1).alias("last_obs"), F.round(F.aggregate("_s", F.lit(0.0), lambda a, v: a + v), 5).alias("sum_obs"), F.size("_s").alias("n_obs")))


_PACK = f"""q1 AS (SELECT *, ln(close / lag(close) OVER ({W_SQL})) AS r FROM bars), q2 AS (SELECT instrument, bar_s, {_roll('avg', 'r', 12)} AS t, {_roll('stddev_pop', 'r', 12)} AS sd FROM q1),
q3 AS (SELECT instrument, bar_s, exp(t / (sd + 1e-12)) AS e0, 1.0 AS e1, exp(-t / (sd + 1e-12)) AS e2 FROM q2 WHERE sd IS NOT NULL),
q4 AS (SELECT instrument, bar_s, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM q3),
pack AS (SELECT *, p0 - lag(p0) OVER ({W_SQL}) AS dp0, greatest(p0, p1, p2) AS p_max, greatest(p0, p1, p2) - (p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2)) AS margin, 1 / (p0 * p0 + p1 * p1 + p2 * p2) AS eff, p1 + 2 * p2 AS expected FROM q4)"""


@query(f"WITH {PANEL}, {_PACK} SELECT instrument, bar_s, {_r('p0 AS p_filter_0;p1 AS p_filter_1;p2 AS p_filter_2;dp0 AS dp_filter_0;p_max AS p_max_filter;margin AS p_margin_filter;eff AS effective_num_states_filter;expected AS expected_state_filter')} FROM pack")
def ref_w22_regime_pack(s: SparkSession, d: str) -> DataFrame:
    """Regime probabilities, their changes and summaries."""
    return rounded(features.regime_pack(bars.panel_bars(s, d)).drop("dp_filter_1", "dp_filter_2"))


# --- joins ---------------------------------------------------------------------------------------------------------------

_FUND = """fund AS (SELECT event_type AS instrument, CAST(floor(epoch(ts) / 28800) * 28800 + 28800 AS BIGINT) AS funding_s, (avg(value) - 50) / 100000 AS funding_rate FROM events WHERE isfinite(value) GROUP BY 1, 2)"""


@query(f"WITH {PANEL}, {_FUND} SELECT b.instrument, b.bar_s, round(b.close, 6) + 0.0 AS close, round(f.funding_rate / 8, 14) + 0.0 AS funding_rate_1h_scaled FROM bars b ASOF LEFT JOIN fund f ON b.instrument = f.instrument AND b.bar_s >= f.funding_s")
def ref_j1_j2_asof_funding(s: SparkSession, d: str) -> DataFrame:
    """Bars with the latest funding rate known at their time."""
    x = joins.attach_funding(bars.panel_bars(s, d), bars.funding_events(s, d)).select("instrument", "bar_s", F.round("close", 6).alias("close"), (F.round("funding_rate_1h_scaled", 14) + 0.0).alias("funding_rate_1h_scaled"))
    return x


@query(f"WITH {PANEL}, {_PACK} SELECT b.instrument, b.bar_s, round(b.close, 6) + 0.0 AS close, round(p.p_max, 6) + 0.0 AS p_max_filter FROM bars b JOIN pack p ON b.instrument = p.instrument AND b.bar_s = p.bar_s")
def ref_j3_j6_regime_merge(s: SparkSession, d: str) -> DataFrame:
    """Bars joined with the regime row of exactly their time, keys checked to be unique; an instrument's first bars have none."""
    b = bars.panel_bars(s, d)
    return rounded(joins.merge_regime(b, features.regime_pack(b), strict=False).select("instrument", "bar_s", "close", "p_max_filter"))


@query(f"WITH {PANEL}, {_PACK} SELECT b.instrument, count(*) AS n_unmatched FROM bars b LEFT JOIN pack p ON b.instrument = p.instrument AND b.bar_s = p.bar_s WHERE p.bar_s IS NULL GROUP BY 1")
def ref_j5_unmatched(s: SparkSession, d: str) -> DataFrame:
    """How many bars have no regime row."""
    b = bars.panel_bars(s, d)
    return joins.unmatched(b, features.regime_pack(b), ["instrument", "bar_s"]).groupBy("instrument").agg(F.count("*").alias("n_unmatched"))


@query(f"""WITH {PANEL}, {_PACK}, {_FUND}, f AS (SELECT b.instrument, b.bar_s, b.close, f.funding_rate FROM bars b ASOF LEFT JOIN fund f ON b.instrument = f.instrument AND b.bar_s >= f.funding_s)
SELECT f.instrument, f.bar_s, {_r('f.close AS close;p.p_max AS p_max_filter', 8)}, round(f.funding_rate / 8, 14) + 0.0 AS funding_1h FROM f JOIN pack p ON f.instrument = p.instrument AND f.bar_s = p.bar_s JOIN (SELECT DISTINCT bar_s FROM bars WHERE instrument = 'click') m ON f.bar_s = m.bar_s WHERE f.funding_rate IS NOT NULL""")
def ref_j7_dataset_chain(s: SparkSession, d: str) -> DataFrame:
    """The dataset build: as-of funding, then a chain of inner joins on exact time, incomplete rows dropped."""
    b = bars.panel_bars(s, d)
    grid = b.where(F.col("instrument") == "click").select("bar_s").distinct()
    x = joins.attach_funding(b, bars.funding_events(s, d)).join(features.regime_pack(b), ["instrument", "bar_s"]).join(grid, "bar_s")
    x = x.where(F.col("funding_rate_1h_scaled").isNotNull()).withColumn("_f", F.col("funding_rate_1h_scaled"))
    # A rate of few decimals may lie on a rounding boundary, so it keeps more of them.
    return x.select("instrument", "bar_s", *[(F.round(c, n) + 0.0).alias(a) for c, n, a in (("close", 8, "close"), ("p_max_filter", 8, "p_max_filter"), ("_f", 14, "funding_1h"))])


# --- splits --------------------------------------------------------------------------------------------------------------

_RN = f"x AS (SELECT *, row_number() OVER ({W_SQL}) - 1 AS rn, count(*) OVER (PARTITION BY instrument) AS n FROM bars)"


@query(f"""WITH {PANEL}, {_RN}, y AS (SELECT *, CASE WHEN rn < floor(n * 0.8) THEN 'train' WHEN rn < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM x)
SELECT instrument, split, count(*) AS n_rows, min(bar_s) AS first_s, max(bar_s) AS last_s FROM y WHERE rn <> floor(n * 0.8) - 1 AND rn <> floor(n * 0.8) + floor(n * 0.1) - 1 GROUP BY 1, 2""")
def ref_k1_chronological_split(s: SparkSession, d: str) -> DataFrame:
    """Train, val and test in order of time, boundary rows dropped."""
    return splits.chronological(bars.panel_bars(s, d)).groupBy("instrument", "split").agg(F.count("*").alias("n_rows"), F.min("bar_s").alias("first_s"), F.max("bar_s").alias("last_s"))


_FOLDS = f"""c AS (SELECT instrument, count(*) AS n FROM days GROUP BY 1), s AS (SELECT instrument, n, greatest(200, round_even(CAST({0.6 + 0.1 + 0.1!r} AS DOUBLE) * n, 0)) AS span, greatest(1, round_even(CAST(0.1 AS DOUBLE) * n, 0)) AS step FROM c),
u AS (SELECT *, round_even(CAST(0.6 AS DOUBLE) * span, 0) AS a, round_even(CAST({0.6 + 0.1!r} AS DOUBLE) * span, 0) AS b, round_even(CAST(0.1 AS DOUBLE) * span, 0) AS c, unnest(range(6)) AS fold FROM s),
v AS (SELECT instrument, fold, fold * step AS o, a, b, least(span, b + 24 + c) AS e FROM u WHERE fold * step + span <= n AND a - 1 >= 50 AND b - 1 - a >= 20 AND least(span, b + 24 + c) - b - 24 >= 20),
folds AS (SELECT instrument, CAST(fold AS INT) AS fold, 'train' AS split, CAST(o AS INT) AS start_rn, CAST(o + a - 1 AS INT) AS end_rn FROM v UNION ALL SELECT instrument, CAST(fold AS INT), 'val', CAST(o + a AS INT), CAST(o + b - 1 AS INT) FROM v
  UNION ALL SELECT instrument, CAST(fold AS INT), 'test', CAST(o + b + 24 AS INT), CAST(o + e AS INT) FROM v)"""
_DAYS = _bars_sql("days", "orders", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", 86_400)
_FOLD_ROWS = f"nr AS (SELECT *, row_number() OVER ({W_SQL}) - 1 AS rn FROM days), fr AS (SELECT nr.*, fold, split FROM nr JOIN folds ON nr.instrument = folds.instrument AND rn >= start_rn AND rn < end_rn)"


@query(f"WITH {_DAYS}, {_FOLDS}, {_FOLD_ROWS} SELECT instrument, fold, split, count(*) AS n_rows, min(bar_s) AS first_s, max(bar_s) AS last_s FROM fr GROUP BY 1, 2, 3")
def ref_k2_k3_walk_forward(s: SparkSession, d: str) -> DataFrame:
    """Rows of each walk-forward fold and split over daily bars, with purge and embargo."""
    return splits.walk_forward(bars.daily_bars(s, d)).groupBy("instrument", "fold", "split").agg(F.count("*").alias("n_rows"), F.min("bar_s").alias("first_s"), F.max("bar_s").alias("last_s"))


@query(f"WITH {_DAYS}, {_FOLDS} SELECT * FROM folds")
def ref_k4_fold_manifest(s: SparkSession, d: str) -> DataFrame:
    """The row ranges of each instrument's folds, cut over its own number of bars."""
    return splits.fold_manifest(bars.daily_bars(s, d))


@query(f"""WITH {PANEL}, {_RN}, y AS (SELECT *, CASE WHEN rn < floor(n * 0.8) THEN 'train' WHEN rn < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM x WHERE rn <> floor(n * 0.8) - 1 AND rn <> floor(n * 0.8) + floor(n * 0.1) - 1),
z AS (SELECT instrument, bar_s, split, (close - avg(close) FILTER (WHERE split = 'train') OVER (PARTITION BY instrument)) / (stddev_pop(close) FILTER (WHERE split = 'train') OVER (PARTITION BY instrument) + 1e-8) AS z FROM y)
SELECT instrument, bar_s, split, round(greatest(-10, least(10, z)), 6) + 0.0 AS close FROM z""")
def ref_k5_frozen_scaling(s: SparkSession, d: str) -> DataFrame:
    """Closes scaled by the train rows' mean and deviation."""
    return rounded(splits.frozen_scaling(splits.chronological(bars.panel_bars(s, d)), ["close"]).select("instrument", "bar_s", "split", "close"))


# --- simulator -----------------------------------------------------------------------------------------------------------

_KEYS = ("instrument", "policy")
_PW = "PARTITION BY instrument, policy ORDER BY bar_s"
_UNIFORM = "CAST(('0x' || substr(md5('0|' || instrument || '|' || bar_s), 1, 8)) AS BIGINT) / 4294967296.0"
_LEDGER = f"""pol AS (SELECT * FROM (VALUES ('flat'), ('long'), ('short'), ('random')) t(policy)),
s0 AS (SELECT instrument, bar_s, ln(lead(close) OVER ({W_SQL}) / close) AS ret_fwd FROM bars),
s1 AS (SELECT instrument, bar_s, ret_fwd, policy, CASE policy WHEN 'flat' THEN 0.0 WHEN 'long' THEN 1.0 WHEN 'short' THEN -1.0 ELSE ({_UNIFORM}) * 2 - 1 END AS pos FROM s0, pol WHERE ret_fwd IS NOT NULL),
s2 AS (SELECT *, lag(pos, 1, 0.0) OVER ({_PW}) AS pos_prev, row_number() OVER ({_PW}) - 1 AS t_index FROM s1),
s3 AS (SELECT *, abs(pos - pos_prev) AS turnover, abs(pos - pos_prev) * 0.0004 AS cost, pos * ret_fwd - abs(pos - pos_prev) * 0.0004 AS pnl_net FROM s2),
s4 AS (SELECT *, exp(sum(pnl_net) OVER ({_PW})) AS equity FROM s3),
s5 AS (SELECT *, greatest(0, least(1, 1 - equity / greatest(1.0, max(equity) OVER ({_PW})))) AS drawdown, min(CASE WHEN equity <= 0.15 THEN t_index END) OVER (PARTITION BY instrument, policy) AS brk FROM s4),
led AS (SELECT * FROM s5 WHERE brk IS NULL OR t_index <= brk)"""


def _trace(s: SparkSession, d: str) -> DataFrame:
    return simulate.ledger(simulate.actions(bars.panel_bars(s, d)))


@query(f"WITH {PANEL}, {_LEDGER} SELECT instrument, policy, bar_s, {_r('pos;pos_prev;turnover;cost;pnl_net;equity;drawdown')} FROM led")
def ref_m1_m6_ledger(s: SparkSession, d: str) -> DataFrame:
    """The step trace of the scripted policies: execution, costs, equity, drawdown, ruin."""
    return rounded(_trace(s, d).select("instrument", "policy", "bar_s", "pos", "pos_prev", "turnover", "cost", "pnl_net", "equity", "drawdown"))


@query(f"""WITH {PANEL}, {_LEDGER}, e0 AS (SELECT *, list(pos) OVER ({_PW} ROWS UNBOUNDED PRECEDING) AS l FROM s1 WHERE policy IN ('long', 'random'))
SELECT instrument, policy, bar_s, round(list_reduce(l, lambda y, v: y * 0.75 + v * 0.25, 0.0), 6) + 0.0 AS pos FROM e0""")
def ref_m3_ewma_execution(s: SparkSession, d: str) -> DataFrame:
    """Positions that approach their target by a quarter each step."""
    t = simulate.ledger(simulate.actions(bars.panel_bars(s, d), ("long", "random")), simulate.SimRules(beta=0.25, ruin=-1.0))
    return rounded(t.select("instrument", "policy", "bar_s", "pos"))


@query(f"""WITH {PANEL}, {_LEDGER}, {_FUND}, a AS (SELECT s3.*, f.funding_rate / 8 AS fr FROM s3 ASOF LEFT JOIN fund f ON s3.instrument = f.instrument AND s3.bar_s >= f.funding_s)
SELECT instrument, policy, round(sum(pos * coalesce(fr, 0)), 8) + 0.0 AS funding, round(exp(sum(pnl_net - pos * coalesce(fr, 0))), 6) + 0.0 AS equity FROM a GROUP BY 1, 2""")
def ref_m4_funding(s: SparkSession, d: str) -> DataFrame:
    """Funding paid and final equity with funding."""
    b = joins.attach_funding(bars.panel_bars(s, d), bars.funding_events(s, d))
    t = simulate.ledger(simulate.actions(b), simulate.SimRules(ruin=-1.0), funding="funding_rate_1h_scaled")
    return t.groupBy(*_KEYS).agg((F.round(F.sum("funding_cost"), 8) + 0.0).alias("funding"), (F.round(F.max_by("equity", "bar_s"), 6) + 0.0).alias("equity"))


@query(f"WITH {PANEL}, {FEATURES_SQL} SELECT instrument, bar_s, round(CASE WHEN vol_roll > 0 THEN greatest(0, least(1, 0.5 / (vol_roll * sqrt(2190.0)))) ELSE 1 END, 6) + 0.0 AS bench_pos, CAST(CASE WHEN ma_ratio > 1 AND rsi >= 50 THEN 1 WHEN ma_ratio < 1 AND rsi <= 50 THEN -1 ELSE 0 END AS DOUBLE) AS naive_pos FROM feat")
def ref_m7_m13_rule_positions(s: SparkSession, d: str) -> DataFrame:
    """Volatility-target benchmark and the naive rule."""
    f = features.bar_features(bars.panel_bars(s, d))
    return rounded(f.select("instrument", "bar_s", simulate.vol_target_position(simulate.first_positive(F.col("sigma_1h"), F.col("vol_roll")), 0.5, FREQ).alias("bench_pos"), simulate.naive_action(F.col("ma_ratio"), F.col("rsi")).alias("naive_pos")))


@query(f"""WITH {PANEL}, {_LEDGER}, w AS (SELECT *, coalesce(pos - lag(pos) OVER ({_PW}), 0) AS da FROM led)
SELECT instrument, policy, {_r('sum(pnl_net) AS pnl;sum(10 * greatest(0, drawdown - 0.1) * abs(pos) / 1e4) AS dd_penalty;sum(-0.001 * da * da) AS smooth_penalty')} FROM w GROUP BY 1, 2""")
def ref_m10_reward(s: SparkSession, d: str) -> DataFrame:
    """Reward parts summed over each rollout."""
    r = simulate.rewards(_trace(s, d))
    return rounded(r.groupBy(*_KEYS).agg(F.sum("pnl_net").alias("pnl"), F.sum("dd_penalty").alias("dd_penalty"), F.sum("smooth_penalty").alias("smooth_penalty")))


@query(f"""WITH {PANEL}, l AS (SELECT instrument, bar_s, coalesce(ln(close / lag(close) OVER ({W_SQL})), 0) AS r FROM bars),
k AS (SELECT *, greatest(0, least(3, 0.5 / (stddev_pop(r) OVER (PARTITION BY instrument) * sqrt(2190.0) + 1e-12))) AS sc FROM l)
SELECT instrument, bar_s, round(exp(sum(r * sc) OVER ({W_SQL})), 6) + 0.0 AS equity_vt FROM k""")
def ref_m12_m14_vol_target_hold(s: SparkSession, d: str) -> DataFrame:
    """Buy and hold scaled to a target volatility."""
    return rounded(simulate.vol_scaled_hold(bars.panel_bars(s, d), 0.5, FREQ).select("instrument", "bar_s", "equity_vt"))


@query()
def ref_m15_policy_hook(s: SparkSession, d: str) -> DataFrame:
    """A policy that sees its own drawdown, rolled out step by step."""
    f = features.usable_rows(features.bar_features(bars.panel_bars(s, d)))
    return rounded(simulate.rollout(f, lambda o: (1.0 if o["rsi"] >= 50 else -1.0) * (0.5 if o["drawdown"] > 0.2 else 1.0), ("rsi",)))


@query(f"""WITH {PANEL}, s0 AS (SELECT instrument, bar_s, ln(lead(close) OVER ({W_SQL}) / close) AS r FROM bars), e AS (SELECT instrument, exp(sum(r) OVER (PARTITION BY instrument ORDER BY bar_s)) AS up, exp(sum(-r) OVER (PARTITION BY instrument ORDER BY bar_s)) AS down FROM s0 WHERE r IS NOT NULL)
SELECT instrument, round(max(abs(ln(up) + ln(down))), 6) + 0.0 AS mirror_error FROM e GROUP BY 1""")
def ref_m16_identities(s: SparkSession, d: str) -> DataFrame:
    """Without frictions, the equities of long and short multiply to one."""
    t = simulate.ledger(simulate.actions(bars.panel_bars(s, d), ("long", "short")), simulate.SimRules(0.0, 0.0, ruin=-1.0)).select("instrument", "bar_s", "policy", "equity")
    both = t.groupBy("instrument", "bar_s").agg(F.sum(F.ln("equity")).alias("e"))
    return rounded(both.groupBy("instrument").agg(F.max(F.abs("e")).alias("mirror_error")))


# --- evaluation ----------------------------------------------------------------------------------------------------------

_METRICS = f"""r0 AS (SELECT *, ln(equity + 1e-12) - lag(ln(equity + 1e-12)) OVER ({_PW}) AS r, 1 - equity / max(equity) OVER ({_PW}) AS dd FROM led),
q AS (SELECT instrument, policy, quantile_cont(r, 0.01) AS q01, quantile_cont(r, 0.05) AS q05, quantile_cont(r, 0.95) AS q95, avg(r) AS mu FROM r0 GROUP BY 1, 2),
m AS (SELECT r0.instrument, r0.policy, count(r) AS n, any_value(mu) AS mu, stddev_pop(r) AS sd, max(dd) AS max_dd, last(equity ORDER BY bar_s) / first(equity ORDER BY bar_s) - 1 AS cum, sqrt(avg(r * r) FILTER (WHERE r < 0)) AS down,
  avg((r - mu) ** 2) AS m2, avg((r - mu) ** 3) AS m3, avg((r - mu) ** 4) AS m4, any_value(q01) AS q01, any_value(q05) AS q05, avg(r) FILTER (WHERE r <= q01) AS c01, avg(r) FILTER (WHERE r <= q05) AS c05, avg(r) FILTER (WHERE r >= q95) AS t95
  FROM r0 JOIN q ON r0.instrument = q.instrument AND r0.policy = q.policy GROUP BY 1, 2)"""


@query(f"""WITH {PANEL}, {_LEDGER}, {_METRICS} SELECT instrument, policy, n, {_r("CASE WHEN n < 2 THEN 0 ELSE mu / (sd + 1e-12) * sqrt(2190.0) END AS sharpe;CASE WHEN n < 2 THEN 0 ELSE sd * sqrt(2190.0) END AS ann_vol;CASE WHEN n < 2 THEN 0 ELSE cum END AS cum_return;CASE WHEN n < 2 THEN 0 ELSE max_dd END AS max_dd;CASE WHEN n < 2 THEN 0 ELSE mu / (coalesce(down, 0) + 1e-12) * sqrt(2190.0) END AS sortino;CASE WHEN n < 2 THEN 0 ELSE m3 / pow(m2 + 1e-12, 1.5) END AS skew;CASE WHEN n < 2 THEN 0 ELSE m4 / pow(m2 + 1e-12, 2) - 3 END AS kurtosis;CASE WHEN n < 2 THEN 0 ELSE q05 END AS var_95;CASE WHEN n < 2 THEN 0 ELSE c05 END AS cvar_95;CASE WHEN n < 2 THEN 0 ELSE q01 END AS var_99;CASE WHEN n < 2 THEN 0 ELSE c01 END AS cvar_99;CASE WHEN n < 2 THEN 0 ELSE t95 / (abs(c05) + 1e-12) END AS tail_ratio", 5)} FROM m WHERE policy <> 'flat'""")
def ref_e1_e10_metrics(s: SparkSession, d: str) -> DataFrame:
    """Metrics of each policy's equity curve."""
    return rounded(metrics.equity_metrics(_trace(s, d).where(F.col("policy") != "flat"), _KEYS, FREQ).drop("ann_return", "calmar"), 5)


@query(f"""WITH {PANEL}, {_LEDGER}, {_METRICS}, t AS (SELECT instrument, policy, avg(turnover) AS tm FROM led GROUP BY 1, 2)
SELECT m.instrument, m.policy, round(CASE WHEN n < 2 THEN 0 ELSE mu / (sd + 1e-12) * sqrt(2190.0) - 2 * greatest(0, max_dd - 0.2) END - greatest(0, tm - 0.01), 5) + 0.0 AS score FROM m JOIN t ON m.instrument = t.instrument AND m.policy = t.policy WHERE m.policy <> 'flat'""")
def ref_e11_north_star(s: SparkSession, d: str) -> DataFrame:
    """Sharpe less penalties for drawdown and turnover."""
    t = _trace(s, d).where(F.col("policy") != "flat")
    m = metrics.equity_metrics(t, _KEYS, FREQ).join(t.groupBy(*_KEYS).agg(F.avg("turnover").alias("tm")), list(_KEYS))
    return rounded(m.select(*_KEYS, metrics.north_star(F.col("sharpe"), F.col("max_dd"), F.col("tm")).alias("score")), 5)


_HOLD_D = f"""h0 AS (SELECT instrument, bar_s, coalesce(ln(close / lag(close) OVER ({W_SQL})), 0) AS lr FROM bars), hold AS (SELECT instrument, bar_s, exp(sum(lr) OVER ({W_SQL})) AS equity FROM h0)"""


@query(f"""WITH {DAILY}, {_HOLD_D}, x AS (SELECT *, strftime(make_timestamp(bar_s * 1000000), '%Y-%m') AS month, ln(equity + 1e-12) - lag(ln(equity + 1e-12)) OVER ({W_SQL}) AS r FROM hold),
y AS (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY instrument, month ORDER BY bar_s) AS dd FROM x),
mo AS (SELECT instrument, month, last(equity ORDER BY bar_s) AS le, stddev_samp(r) AS sd, avg(r) AS mu, count(r) AS n, max(dd) AS max_dd FROM y GROUP BY 1, 2), p AS (SELECT *, lag(le) OVER (PARTITION BY instrument ORDER BY month) AS pe FROM mo)
SELECT instrument, month, {_r('le / pe - 1 AS return;sd * sqrt(365.0) AS vol;CASE WHEN n >= 5 THEN mu / (sd + 1e-12) * sqrt(365.0) END AS sharpe;max_dd', 5)} FROM p WHERE pe IS NOT NULL""")
def ref_e12_monthly(s: SparkSession, d: str) -> DataFrame:
    """Monthly return, volatility, Sharpe and drawdown of daily buy and hold."""
    return rounded(metrics.monthly(simulate.hold_equity(bars.daily_bars(s, d)), ("instrument",), DAY_FREQ), 5)


@query(f"""WITH {PANEL}, {_HOLD_D}, x AS (SELECT *, 1 - equity / max(equity) OVER ({W_SQL}) AS dd, row_number() OVER ({W_SQL}) - 1 AS i FROM hold),
y AS (SELECT *, sum(CASE WHEN dd <= 1e-12 THEN 1 ELSE 0 END) OVER ({W_SQL}) AS island, min(CASE WHEN dd <= 1e-12 THEN i END) OVER ({W_SQL} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rec FROM x),
e AS (SELECT instrument, island, min(i) AS start, last(i ORDER BY dd, i) AS trough, any_value(rec) AS recovery, max(dd) AS depth, max(i) AS e FROM y WHERE dd > 1e-12 GROUP BY 1, 2)
SELECT instrument, start, trough, recovery, round(depth, 6) + 0.0 AS depth, coalesce(recovery, e) - start AS duration_bars, recovery - trough AS recovery_bars FROM e""")
def ref_e13_drawdown_events(s: SparkSession, d: str) -> DataFrame:
    """Stretches under water."""
    e = metrics.drawdown_events(simulate.hold_equity(bars.panel_bars(s, d)), ("instrument",))
    return rounded(e.select("instrument", *[F.col(c).cast("bigint").alias(c) if c != "depth" else F.col(c) for c in ("start", "trough", "recovery", "depth", "duration_bars", "recovery_bars")]))


_TRADES = f"""t0 AS (SELECT *, CASE WHEN pos > 0.001 THEN 1 WHEN pos < -0.001 THEN -1 ELSE 0 END AS side, row_number() OVER ({_PW}) - 1 AS i, lead(equity) OVER ({_PW}) AS nx FROM led),
t1 AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER ({_PW}) THEN 1 ELSE 0 END AS nw FROM t0), t2 AS (SELECT *, sum(nw) OVER ({_PW}) AS run FROM t1),
t3 AS (SELECT instrument, policy, run, side, min(i) AS a, max(i) AS z, first(equity ORDER BY i) AS e0, max(equity) AS hi, min(equity) AS lo, last(nx ORDER BY i) AS e1 FROM t2 GROUP BY 1, 2, 3, 4),
tr AS (SELECT instrument, policy, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS side, a AS entry_i, z + 1 AS exit_i, z + 2 - a AS duration_bars, e1 - e0 AS pnl, e1 / e0 - 1 AS ret, greatest(hi, e1) / e0 - 1 AS mfe, least(lo, e1) / e0 - 1 AS mae FROM t3 WHERE side <> 0 AND e1 IS NOT NULL)"""


@query(f"WITH {PANEL}, {_LEDGER}, {_TRADES} SELECT instrument, policy, side, entry_i, exit_i, duration_bars, {_r('pnl;ret AS return;mfe;mae')} FROM tr")
def ref_e14_trades(s: SparkSession, d: str) -> DataFrame:
    """Directional trades."""
    t = metrics.trades(_trace(s, d), _KEYS)
    return rounded(t.withColumns({c: F.col(c).cast("bigint") for c in ("entry_i", "exit_i", "duration_bars")}))


@query(f"WITH {PANEL}, {_LEDGER} SELECT instrument, policy, bar_s, 'rebalance' AS type, {_r('pos_prev;pos;pos - pos_prev AS dpos')} FROM led WHERE abs(pos - pos_prev) >= 0.02")
def ref_e15_rebalances(s: SparkSession, d: str) -> DataFrame:
    """Rows whose position moved noticeably."""
    return rounded(metrics.rebalances(_trace(s, d), _KEYS))


@query(f"""WITH {PANEL}, {_LEDGER}, {_TRADES} SELECT instrument, policy, count(*) AS n_trades, {_r('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate;avg(ret) AS avg_return;avg(duration_bars) AS avg_duration;coalesce(sum(ret) FILTER (WHERE ret > 0), 0) / (abs(coalesce(sum(ret) FILTER (WHERE ret < 0), 0)) + 1e-12) AS profit_factor', 5)} FROM tr GROUP BY 1, 2""")
def ref_e16_trade_stats(s: SparkSession, d: str) -> DataFrame:
    """Win rate, average return and profit factor."""
    return rounded(metrics.trade_stats(metrics.trades(_trace(s, d), _KEYS), _KEYS), 5)


@query(f"""WITH {PANEL}, {_LEDGER} SELECT instrument, policy, {_r('avg(CASE WHEN pos > 0.001 THEN 1.0 ELSE 0.0 END) AS pct_long;avg(CASE WHEN pos < -0.001 THEN 1.0 ELSE 0.0 END) AS pct_short;avg(CASE WHEN abs(pos) <= 0.001 THEN 1.0 ELSE 0.0 END) AS pct_flat;avg(turnover) AS turnover_mean;avg(abs(pos)) AS mean_abs_pos;sum(turnover * greatest(equity, 0)) AS notional_turnover;sum(cost) AS total_cost;CAST(0 AS DOUBLE) AS total_funding')} FROM led GROUP BY 1, 2""")
def ref_a8_e17_position_stats(s: SparkSession, d: str) -> DataFrame:
    """Shares of long, short and flat, turnover and costs."""
    return rounded(metrics.position_stats(_trace(s, d), _KEYS))


@query(f"""WITH {PANEL}, {_LEDGER} SELECT instrument, policy, bar_s, {_r('sum(cost) OVER (PARTITION BY instrument, policy ORDER BY bar_s) AS cum_cost;equity + sum(cost) OVER (PARTITION BY instrument, policy ORDER BY bar_s) AS gross_equity')} FROM led""")
def ref_w13_e19_costs(s: SparkSession, d: str) -> DataFrame:
    """Cumulative costs and equity before them."""
    c = W.running(F.sum("cost"), W.series(*_KEYS))
    return rounded(_trace(s, d).select(*_KEYS, "bar_s", c.alias("cum_cost"), (F.col("equity") + c).alias("gross_equity")))


@query(f"""WITH {PANEL}, {_LEDGER} SELECT policy, CASE WHEN pos > 0.001 THEN 'long' WHEN pos < -0.001 THEN 'short' ELSE 'flat' END AS regime, count(*) AS n, {_r('avg(pnl_net) AS mean;sum(pnl_net) AS total;stddev_samp(pnl_net) AS std')} FROM led GROUP BY 1, 2""")
def ref_a1_e20_attribution(s: SparkSession, d: str) -> DataFrame:
    """Profit by side: count, mean, sum and sample deviation."""
    side = F.when(F.col("pos") > 1e-3, "long").when(F.col("pos") < -1e-3, "short").otherwise("flat")
    return rounded(_trace(s, d).groupBy("policy", side.alias("regime")).agg(F.count("*").alias("n"), F.avg("pnl_net").alias("mean"), F.sum("pnl_net").alias("total"), F.stddev_samp("pnl_net").alias("std")))


@query(f"""WITH {PANEL}, {_LEDGER}, {_METRICS} SELECT a.instrument, a.policy, round(CASE WHEN a.n < 2 THEN 0 ELSE a.cum END - CASE WHEN b.n < 2 THEN 0 ELSE b.cum END, 6) + 0.0 AS delta_cum_return, round(CASE WHEN a.n < 2 THEN 0 ELSE a.max_dd END - CASE WHEN b.n < 2 THEN 0 ELSE b.max_dd END, 6) + 0.0 AS delta_max_dd FROM m a JOIN m b ON a.instrument = b.instrument AND b.policy = 'long' WHERE a.policy <> 'long'""")
def ref_e21_delta_vs_baseline(s: SparkSession, d: str) -> DataFrame:
    """Metrics less those of always-long."""
    m = metrics.equity_metrics(_trace(s, d), _KEYS, FREQ)
    base = m.where(F.col("policy") == "long").select("instrument", F.col("cum_return").alias("_c"), F.col("max_dd").alias("_d"))
    return rounded(m.where(F.col("policy") != "long").join(base, "instrument").select("instrument", "policy", (F.col("cum_return") - F.col("_c")).alias("delta_cum_return"), (F.col("max_dd") - F.col("_d")).alias("delta_max_dd")))


@query(f"""WITH {PANEL}, x AS (SELECT instrument, volume AS v FROM bars), l AS (SELECT *, min(v) OVER (PARTITION BY instrument) AS lo, max(v) OVER (PARTITION BY instrument) AS hi FROM x)
SELECT instrument, CAST(coalesce(least(79, floor((v - lo) / nullif(hi - lo, 0) * 80)), 0) AS INT) AS bin, count(*) AS n FROM l GROUP BY 1, 2""")
def ref_e22_histogram(s: SparkSession, d: str) -> DataFrame:
    """Histogram data of bar volumes."""
    return metrics.histogram(bars.panel_bars(s, d), ("instrument",), "volume")


_QQ = [(i + 0.5) / 40 for i in range(40)]


@query(f"""WITH {PANEL}, l AS (SELECT instrument, ln(close / lag(close) OVER ({W_SQL})) AS r FROM bars), q AS (SELECT instrument, unnest(range(40)) AS i, unnest(quantile_cont(r, {_QQ})) AS sample, unnest({[norm_ppf(p) for p in _QQ]}) AS normal FROM l WHERE r IS NOT NULL GROUP BY 1)
SELECT instrument, CAST(i AS INT) AS i, {_r('sample;normal')} FROM q""")
def ref_e22_qq_points(s: SparkSession, d: str) -> DataFrame:
    """Quantiles of returns against those of the normal distribution."""
    w = W.series("instrument")
    r = bars.panel_bars(s, d).withColumn("r", W.log_return(F.col("close"), w)).where(F.col("r").isNotNull())
    p = _QQ
    q = r.groupBy("instrument").agg(F.percentile("r", F.array(*[F.lit(x) for x in p])).alias("_q"))
    theory = F.array(*[F.lit(norm_ppf(x)) for x in p])
    return rounded(q.select("instrument", F.posexplode(F.arrays_zip(F.col("_q").alias("sample"), theory.alias("normal"))).alias("i", "_z")).select("instrument", "i", F.col("_z.sample").alias("sample"), F.col("_z.normal").alias("normal")))


@query(f"""WITH {DAILY}, {_HOLD_D}, x AS (SELECT instrument, bar_s, equity, make_timestamp(bar_s * 1000000) AS t FROM hold), mo AS (SELECT instrument, year(t) AS y, month(t) AS m, last(equity ORDER BY bar_s) AS le FROM x GROUP BY 1, 2, 3),
p AS (SELECT instrument, y, m, le / lag(le) OVER (PARTITION BY instrument ORDER BY y, m) - 1 AS r FROM mo) SELECT instrument, CAST(y AS INT) AS y, {_r(';'.join(f"max(r) FILTER (WHERE m = {k}) AS m{k:02d}" for k in range(1, 13)))} FROM p GROUP BY 1, 2""")
def ref_f7_month_pivot(s: SparkSession, d: str) -> DataFrame:
    """Year by month returns."""
    t = F.timestamp_seconds("bar_s")
    m = simulate.hold_equity(bars.daily_bars(s, d)).groupBy("instrument", F.year(t).alias("y"), F.month(t).alias("m")).agg(F.max_by("equity", "bar_s").alias("le"))
    m = m.withColumn("r", F.col("le") / F.lag("le").over(Window.partitionBy("instrument").orderBy("y", "m")) - 1)
    p = m.groupBy("instrument", "y").pivot("m", list(range(1, 13))).agg(F.max("r"))
    return rounded(p.toDF("instrument", "y", *[f"m{k:02d}" for k in range(1, 13)]))


# --- aggregations --------------------------------------------------------------------------------------------------------

_RUNS = """u AS (SELECT * FROM run_walkforward WHERE isfinite(sharpe) AND isfinite(max_dd))"""


@query(f"""WITH {_RUNS} SELECT fold, count(*) AS n, {_r('avg(sharpe) AS mean;stddev_pop(sharpe) AS std;quantile_cont(sharpe, 0.1) AS p10;quantile_cont(sharpe, 0.5) AS p50;quantile_cont(sharpe, 0.9) AS p90', 5)} FROM u GROUP BY 1""")
def ref_a2_fold_summary(s: SparkSession, d: str) -> DataFrame:
    """Sharpe by fold."""
    u = table(s, d, "run_walkforward").where(is_finite(F.col("sharpe")) & is_finite(F.col("max_dd")))
    q = exact_percentiles(u, ["fold"], F.col("sharpe"), (0.1, 0.5, 0.9), ("p10", "p50", "p90")).select(F.col("fold").alias("_fold"), "p10", "p50", "p90")
    m = u.groupBy("fold").agg(F.count("*").alias("n"), F.avg("sharpe").alias("mean"), F.stddev_pop("sharpe").alias("std"))
    return rounded(m.join(q, F.col("fold").eqNullSafe(F.col("_fold"))).drop("_fold"), 5)


@query("""WITH l AS (SELECT 'cumret' AS metric, cumret AS x FROM run_walkforward UNION ALL SELECT 'max_dd', max_dd FROM run_walkforward UNION ALL SELECT 'sharpe', sharpe FROM run_walkforward)
SELECT metric, count(*) AS n, round(avg(x), 5) + 0.0 AS mean, round(stddev_pop(x), 5) + 0.0 AS std, round(min(x), 5) + 0.0 AS min, round(max(x), 5) + 0.0 AS max, round(quantile_cont(x, 0.05), 5) + 0.0 AS q05, round(quantile_cont(x, 0.5), 5) + 0.0 AS q50, round(quantile_cont(x, 0.95), 5) + 0.0 AS q95 FROM l WHERE isfinite(x) GROUP BY 1""")
def ref_a3_distribution(s: SparkSession, d: str) -> DataFrame:
    """Distribution of each metric."""
    return rounded(robustness.distribution(table(s, d, "run_walkforward"), ["cumret", "max_dd", "sharpe"]), 5)


@query("""SELECT pack_id, segment, count(*) AS n, CAST(floor(epoch(min("timestamp"))) AS BIGINT) AS first_s, CAST(floor(epoch(max("timestamp"))) AS BIGINT) AS last_s FROM rl_observation_pack GROUP BY 1, 2""")
def ref_a5_segment_ranges(s: SparkSession, d: str) -> DataFrame:
    """Rows and time range of each segment, unnamed ones included."""
    return table(s, d, "rl_observation_pack").groupBy("pack_id", "segment").agg(F.count("*").alias("n"), F.unix_seconds(F.min("timestamp")).alias("first_s"), F.unix_seconds(F.max("timestamp")).alias("last_s"))


_PACK_NULLS = ("timestamp", "segment", "p_max_filter", "dp_filter_0", "digest")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS column_name, round(avg(CASE WHEN "{c}" IS NULL{' OR isnan("' + c + '")' if 'filter' in c else ''} THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS null_share FROM rl_observation_pack""" for c in _PACK_NULLS))
def ref_a6_null_shares(s: SparkSession, d: str) -> DataFrame:
    """Null share of columns."""
    return rounded(audit.null_shares(table(s, d, "rl_observation_pack").select(*_PACK_NULLS)))


@query(f"WITH {_RUNS}, g AS (SELECT wf_id, seed, avg(sharpe) AS m FROM u GROUP BY 1, 2) SELECT wf_id, round(max(m), 6) + 0.0 AS best_seed_mean, (SELECT round(quantile_cont(sharpe, 0.5), 6) FROM u u2 WHERE u2.wf_id IS NOT DISTINCT FROM g.wf_id) + 0.0 AS median_sharpe FROM g GROUP BY 1".replace("(SELECT round(quantile_cont(sharpe, 0.5), 6) FROM u u2 WHERE u2.wf_id IS NOT DISTINCT FROM g.wf_id) + 0.0 AS median_sharpe", "count(*) AS n_seeds"))
def ref_a7_best_seed(s: SparkSession, d: str) -> DataFrame:
    """The best seed's mean of each walk-forward."""
    u = table(s, d, "run_walkforward").where(is_finite(F.col("sharpe")) & is_finite(F.col("max_dd")))
    return rounded(u.groupBy("wf_id", "seed").agg(F.avg("sharpe").alias("m")).groupBy("wf_id").agg(F.max("m").alias("best_seed_mean"), F.count("*").alias("n_seeds")))


@query("""WITH x AS (SELECT pack_id, p_filter_0 + p_filter_1 + p_filter_2 AS s FROM rl_observation_pack) SELECT pack_id, round(avg(s), 6) + 0.0 AS mean_sum, round(min(s), 6) + 0.0 AS min_sum, round(max(s), 6) + 0.0 AS max_sum, count(*) FILTER (WHERE abs(s - 1) > 1e-4) AS n_off FROM x GROUP BY 1""")
def ref_a10_f8_probability_sums(s: SparkSession, d: str) -> DataFrame:
    """Sums of regime probabilities."""
    return rounded(audit.probability_sums(table(s, d, "rl_observation_pack"), "pack_id", ["p_filter_0", "p_filter_1", "p_filter_2"]))


@query("""WITH x AS (SELECT pack_id, epoch_us("timestamp") AS us FROM rl_observation_pack WHERE "timestamp" IS NOT NULL), y AS (SELECT *, us - lag(us) OVER (PARTITION BY pack_id ORDER BY us) AS gap FROM x)
SELECT pack_id, count(*) AS n_rows, count(DISTINCT us) AS n_distinct, count(*) - count(DISTINCT us) AS n_repeated, min(gap) AS min_gap, max(gap) AS max_gap, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS median_gap FROM y GROUP BY 1""")
def ref_a11_x4_pack_report(s: SparkSession, d: str) -> DataFrame:
    """Repeated times and gaps of each pack."""
    return audit.pack_report(table(s, d, "rl_observation_pack").select("pack_id", F.unix_micros("timestamp").alias("us")), "pack_id", "us")


# --- robustness ----------------------------------------------------------------------------------------------------------

@query(f"""WITH {PANEL}, {_LEDGER} SELECT policy, {_r('quantile_cont(abs(pos), 0.95) AS pos_q95;quantile_cont(turnover, 0.5) AS turnover_q50;quantile_cont(turnover, 0.95) AS turnover_q95;quantile_cont(cost, 0.95) AS cost_q95;quantile_cont(pnl_net, 0.05) AS pnl_q05')} FROM led GROUP BY 1""")
def ref_r1_behaviour(s: SparkSession, d: str) -> DataFrame:
    """Tails of positions, turnover, costs and profit."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return rounded(_trace(s, d).groupBy("policy").agg(q(F.abs("pos"), 0.95).alias("pos_q95"), q("turnover", 0.5).alias("turnover_q50"), q("turnover", 0.95).alias("turnover_q95"), q("cost", 0.95).alias("cost_q95"), q("pnl_net", 0.05).alias("pnl_q05")))


@query(f"""WITH {PANEL}, {_LEDGER}, x AS (SELECT instrument, policy, bar_s, m AS multiplier, pnl_net - (m - 1) * cost AS r FROM led, (VALUES (0.0), (1.0), (2.0), (4.0)) t(m)),
y AS (SELECT *, exp(sum(r) OVER (PARTITION BY instrument, policy, multiplier ORDER BY bar_s)) AS e FROM x), z AS (SELECT *, 1 - e / greatest(1.0, max(e) OVER (PARTITION BY instrument, policy, multiplier ORDER BY bar_s)) AS dd FROM y)
SELECT instrument, policy, CAST(multiplier AS DOUBLE) AS multiplier, {_r('exp(sum(r)) - 1 AS cum_return;max(dd) AS max_dd')} FROM z GROUP BY 1, 2, 3""")
def ref_a4_r2_cost_sensitivity(s: SparkSession, d: str) -> DataFrame:
    """Return and drawdown with costs taken 0, 1, 2 and 4 times."""
    return rounded(robustness.cost_sensitivity(_trace(s, d), _KEYS, (0, 1, 2, 4), FREQ).drop("sharpe"))


def _returns(s: SparkSession, d: str) -> DataFrame:
    w = W.series("instrument")
    x = bars.panel_bars(s, d).withColumn("r", W.log_return(F.col("close"), w)).where(F.col("r").isNotNull())
    return x.select("instrument", "r", (F.row_number().over(w) - 1).alias("rn"))


_BOOT = f"""b0 AS (SELECT instrument, bar_s, ln(close / lag(close) OVER ({W_SQL})) AS r FROM bars), ret AS (SELECT instrument, r, row_number() OVER ({W_SQL}) - 1 AS rn FROM b0 WHERE r IS NOT NULL),
sz AS (SELECT instrument, count(*) AS n, avg(r) AS mu FROM ret GROUP BY 1),
dr AS (SELECT instrument, n, boot, b, CAST(floor(CAST(('0x' || substr(md5('0|' || instrument || '|' || boot || '|' || b), 1, 8)) AS BIGINT) / 4294967296.0 * {{room}}) AS BIGINT) AS start FROM sz, range({{boots}}) t(boot), range(1000) u(b) WHERE b < ceil(n / {{block}}.0)),
ix AS (SELECT instrument, boot, (start + k) % n AS rn FROM dr, range({{block}}) v(k) WHERE b * {{block}} + k < n)"""


@query(f"""WITH {PANEL}, {_BOOT.format(room='n', boots=100, block=12)}, bm AS (SELECT ix.instrument, boot, avg(r) / (stddev_pop(r) + 1e-12) * sqrt(2190.0) AS sharpe, exp(sum(r)) - 1 AS cum_return FROM ix JOIN ret ON ix.instrument = ret.instrument AND ix.rn = ret.rn GROUP BY 1, 2)
SELECT instrument, {_r('quantile_cont(sharpe, 0.05) AS sharpe_lo;quantile_cont(sharpe, 0.5) AS sharpe_median;quantile_cont(sharpe, 0.95) AS sharpe_hi;quantile_cont(cum_return, 0.05) AS cum_return_lo;quantile_cont(cum_return, 0.5) AS cum_return_median;quantile_cont(cum_return, 0.95) AS cum_return_hi', 5)} FROM bm GROUP BY 1""")
def ref_r3_r4_bootstrap(s: SparkSession, d: str) -> DataFrame:
    """Block-bootstrap confidence limits."""
    return rounded(robustness.summarize_bootstrap(robustness.bootstrap_metrics(_returns(s, d), "instrument", 100, 12, FREQ), "instrument"), 5)


@query(f"""WITH {PANEL}, {_BOOT.format(room='n', boots=500, block=48)}, bm AS (SELECT ix.instrument, boot, avg(r) / (stddev_pop(r) + 1e-12) * sqrt(2190.0) AS sharpe, exp(sum(r)) - 1 AS cum_return FROM ix JOIN ret ON ix.instrument = ret.instrument AND ix.rn = ret.rn GROUP BY 1, 2)
SELECT instrument, {_r('quantile_cont(sharpe, 0.05) AS sharpe_lo;quantile_cont(sharpe, 0.5) AS sharpe_median;quantile_cont(sharpe, 0.95) AS sharpe_hi;quantile_cont(cum_return, 0.05) AS cum_return_lo;quantile_cont(cum_return, 0.5) AS cum_return_median;quantile_cont(cum_return, 0.95) AS cum_return_hi', 5)} FROM bm GROUP BY 1""")
def ref_r3_r4_bootstrap_500x48(s: SparkSession, d: str) -> DataFrame:
    """Block-bootstrap confidence limits at the survey's size, 500 draws of blocks of 48."""
    return rounded(robustness.summarize_bootstrap(robustness.bootstrap_metrics(_returns(s, d), "instrument", 500, 48, FREQ), "instrument"), 5)


@query(f"""WITH {PANEL}, {_BOOT.format(room='greatest(1, n - 12 + 1)', boots=200, block=12)}, bm AS (SELECT ix.instrument, boot, avg(r) - any_value(mu) AS d FROM ix JOIN ret ON ix.instrument = ret.instrument AND ix.rn = ret.rn JOIN sz ON ix.instrument = sz.instrument GROUP BY 1, 2),
tp AS (SELECT boot, max(d) AS top FROM bm GROUP BY 1), ob AS (SELECT max(mu) AS o FROM sz) SELECT round(any_value(o), 8) + 0.0 AS observed, round((count(*) FILTER (WHERE top >= o) + 1) / (count(*) + 1), 6) + 0.0 AS p_value FROM tp, ob""")
def ref_r8_r9_reality_check(s: SparkSession, d: str) -> DataFrame:
    """The best instrument's mean return against chance."""
    x = robustness.reality_check(_returns(s, d), "instrument", 200, 12)
    return x.select((F.round("observed", 8) + 0.0).alias("observed"), (F.round("p_value", 6) + 0.0).alias("p_value"))


@query(f"""WITH {PANEL}, {_BOOT.format(room='greatest(1, n - 48 + 1)', boots=2000, block=48)}, bm AS (SELECT ix.instrument, boot, avg(r) - any_value(mu) AS d FROM ix JOIN ret ON ix.instrument = ret.instrument AND ix.rn = ret.rn JOIN sz ON ix.instrument = sz.instrument GROUP BY 1, 2),
tp AS (SELECT boot, max(d) AS top FROM bm GROUP BY 1), ob AS (SELECT max(mu) AS o FROM sz) SELECT round(any_value(o), 8) + 0.0 AS observed, round((count(*) FILTER (WHERE top >= o) + 1) / (count(*) + 1), 6) + 0.0 AS p_value FROM tp, ob""")
def ref_r9_reality_check_2000x48(s: SparkSession, d: str) -> DataFrame:
    """The best instrument's mean return against chance at the survey's size, 2 000 draws of blocks of 48."""
    x = robustness.reality_check(_returns(s, d), "instrument", 2000, 48)
    return x.select((F.round("observed", 8) + 0.0).alias("observed"), (F.round("p_value", 6) + 0.0).alias("p_value"))


@query(f"""WITH {PANEL}, x0 AS (SELECT instrument, bar_s, ln(close / lag(close) OVER ({W_SQL})) AS lr FROM bars), x1 AS (SELECT *, {_roll('avg', 'lr', 20)} AS m0, {_roll('stddev_samp', 'lr', 20)} AS s0, count(*) OVER (PARTITION BY instrument) AS n FROM x0),
x2 AS (SELECT *, first(m0 IGNORE NULLS) OVER ({W_SQL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m, first(s0 IGNORE NULLS) OVER ({W_SQL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sd FROM x1),
md AS (SELECT instrument, quantile_cont(sd, 0.5) AS mid FROM x2 GROUP BY 1)
SELECT x2.instrument, CASE WHEN n < 30 THEN 'unknown' WHEN lr IS NULL THEN 'start' ELSE (CASE WHEN m >= 0 THEN 'bull' ELSE 'bear' END) || '_' || (CASE WHEN sd >= mid THEN 'high_vol' ELSE 'low_vol' END) END AS regime, count(*) AS n FROM x2 JOIN md ON x2.instrument = md.instrument GROUP BY 1, 2""")
def ref_w16_r5_regimes(s: SparkSession, d: str) -> DataFrame:
    """Bars by bull or bear and high or low volatility."""
    return robustness.regimes(bars.panel_bars(s, d), "instrument", 20, 20).groupBy("instrument", "regime").agg(F.count("*").alias("n"))


_REGIME = f"""x0 AS (SELECT instrument, bar_s, ln(close / lag(close) OVER ({W_SQL})) AS lr FROM bars), x1 AS (SELECT *, {_roll('avg', 'lr', 20)} AS m0, {_roll('stddev_samp', 'lr', 20)} AS s0, count(*) OVER (PARTITION BY instrument) AS n FROM x0),
x2 AS (SELECT *, first(m0 IGNORE NULLS) OVER ({W_SQL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m, first(s0 IGNORE NULLS) OVER ({W_SQL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sd FROM x1), md AS (SELECT instrument, quantile_cont(sd, 0.5) AS mid FROM x2 GROUP BY 1),
reg AS (SELECT x2.instrument, bar_s, CASE WHEN n < 30 THEN 'unknown' WHEN lr IS NULL THEN 'start' ELSE (CASE WHEN m >= 0 THEN 'bull' ELSE 'bear' END) || '_' || (CASE WHEN sd >= mid THEN 'high_vol' ELSE 'low_vol' END) END AS regime FROM x2 JOIN md ON x2.instrument = md.instrument)"""


@query(f"""WITH {PANEL}, {_REGIME}, {_HOLD_D}, y AS (SELECT reg.*, equity, count(*) OVER (PARTITION BY reg.instrument, regime) AS n FROM reg JOIN hold ON reg.instrument = hold.instrument AND reg.bar_s = hold.bar_s),
z AS (SELECT *, ln(equity + 1e-12) - lag(ln(equity + 1e-12)) OVER w AS r, 1 - equity / max(equity) OVER w AS dd FROM y WHERE n >= 20 WINDOW w AS (PARTITION BY instrument, regime ORDER BY bar_s))
SELECT instrument, regime, count(r) AS n, {_r('avg(r) / (stddev_pop(r) + 1e-12) * sqrt(2190.0) AS sharpe;max(dd) AS max_dd', 5)} FROM z GROUP BY 1, 2""")
def ref_r6_metrics_by_regime(s: SparkSession, d: str) -> DataFrame:
    """Metrics of the bars of each regime with at least 20 of them."""
    x = robustness.regimes(simulate.hold_equity(bars.panel_bars(s, d)).drop("log_ret"), "instrument", 20, 20)
    n = F.count("*").over(Window.partitionBy("instrument", "regime"))
    return rounded(metrics.equity_metrics(x.withColumn("_n", n).where(F.col("_n") >= 20), ("instrument", "regime"), FREQ).select("instrument", "regime", "n", "sharpe", "max_dd"), 5)


_TAIL = "CASE WHEN z >= 0 THEN q ELSE 1 - q END"


@query(f"""WITH {PANEL}, {_LEDGER}, {_METRICS}, a AS (SELECT instrument, policy, n, CASE WHEN n < 2 THEN 0 ELSE mu / (sd + 1e-12) END AS sr, CASE WHEN n < 2 THEN 0 ELSE m3 / pow(m2 + 1e-12, 1.5) END AS sk, CASE WHEN n < 2 THEN 3 ELSE m4 / pow(m2 + 1e-12, 2) END AS ku FROM m WHERE policy <> 'flat'),
t AS (SELECT count(DISTINCT policy) * count(DISTINCT instrument) AS trials FROM a),
b AS (SELECT *, sqrt(2 * ln(trials)) / sqrt(greatest(5, n) - 1) AS st FROM a, t), c AS (SELECT *, (sr - st) * sqrt(greatest(5, n) - 1) / sqrt(greatest(1e-12, 1 - sk * sr + (ku - 1) / 4 * sr * sr)) AS z FROM b),
e AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM c), f AS (SELECT *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS q FROM e)
SELECT instrument, policy, {_r(f'sr AS sharpe;st AS sr_star;z;{_TAIL} AS p_value', 5)} FROM f""")
def ref_r7_deflated_sharpe(s: SparkSession, d: str) -> DataFrame:
    """Each curve's Sharpe ratio for a bar against the best of as many trials as there are curves."""
    m = metrics.equity_metrics(_trace(s, d).where(F.col("policy") != "flat"), _KEYS, 1.0)
    trials = m.agg((F.count_distinct("policy") * F.count_distinct("instrument")).alias("trials")).withColumn("_one", F.lit(1))
    x = m.withColumn("_one", F.lit(1)).join(F.broadcast(trials), "_one")  # one row
    own = robustness.deflated_sharpe_columns(F.col("sharpe"), F.col("trials"), F.col("n"), F.col("skew"), F.col("kurtosis") + 3)
    return rounded(x.select(*_KEYS, "sharpe", own["sr_star"].alias("sr_star"), own["z"].alias("z"), robustness.upper_tail(own["z"]).alias("p_value")), 5)


@query(f"""WITH {DAILY}, {_HOLD_D}, x AS (SELECT *, row_number() OVER ({W_SQL}) - 1 AS rn, count(*) OVER (PARTITION BY instrument) AS n FROM hold),
wv AS (SELECT a.instrument, a.rn, b.rn - a.rn AS j, b.equity, max(b.equity) OVER (PARTITION BY a.instrument, a.rn ORDER BY b.rn) AS pk FROM x a JOIN x b ON a.instrument = b.instrument AND b.rn BETWEEN a.rn AND a.rn + 719 WHERE a.rn < a.n - 720 AND a.n >= 725),
wm AS (SELECT instrument, rn, last(equity ORDER BY j) / first(equity ORDER BY j) - 1 AS cum_return, max(1 - equity / pk) AS max_dd FROM wv GROUP BY 1, 2),
a AS (SELECT *, 'cum_return' AS rank_type, row_number() OVER (PARTITION BY instrument ORDER BY cum_return, rn) AS k FROM wm UNION ALL SELECT *, 'max_dd', row_number() OVER (PARTITION BY instrument ORDER BY max_dd DESC, rn) FROM wm)
SELECT instrument, CAST(rn AS BIGINT) AS rn, {_r('cum_return;max_dd')}, CAST(k AS INT) AS k, rank_type FROM a WHERE k <= 5""")
def ref_w21_o5_r10_stress(s: SparkSession, d: str) -> DataFrame:
    """The five worst windows of 720 days by return and by drawdown."""
    x = robustness.stress_windows(simulate.hold_equity(bars.daily_bars(s, d)), "instrument", 720, 5)
    return rounded(x.withColumn("rn", F.col("rn").cast("bigint")))


# --- audit ---------------------------------------------------------------------------------------------------------------

@query(f"""WITH {HOURLY}, g AS (SELECT *, bar_s - lag(bar_s) OVER ({W_SQL}) AS gap FROM bars)
SELECT instrument, count(*) AS n_rows, min(bar_s) AS first_s, max(bar_s) AS last_s, count(*) FILTER (WHERE gap = 0) AS n_repeated, count(*) FILTER (WHERE gap > 3600) AS n_gaps, max(gap) AS max_gap_s, count(*) FILTER (WHERE abs(gap - 3600) > 0.0036) AS n_off_step, count(*) FILTER (WHERE NOT isfinite(close)) AS n_not_finite, {_r('quantile_cont(close, 0.01) AS p01;quantile_cont(close, 0.5) AS p50;quantile_cont(close, 0.99) AS p99')} FROM g GROUP BY 1""")
def ref_x1_x2_data_report(s: SparkSession, d: str) -> DataFrame:
    """Rows, range, gaps and quantiles of hourly bars."""
    return rounded(audit.data_report(bars.panel_bars(s, d, 3600), "instrument", "bar_s", 3600, "close"))


@query()
def ref_x6_digest(s: SparkSession, d: str) -> DataFrame:
    """A digest of the panel's bars."""
    return audit.digest(rounded(bars.panel_bars(s, d), 8))


@query("""WITH a AS (SELECT venue, symbol, CAST(NULL AS DOUBLE) AS rate FROM train_v1_dataset UNION ALL SELECT venue, symbol, funding_rate FROM funding_8h),
b AS (SELECT venue, symbol FROM train_v1_dataset INTERSECT SELECT venue, symbol FROM funding_8h WHERE funding_rate > 0)
SELECT a.venue, a.symbol, count(*) AS n, count(rate) AS n_rates FROM a JOIN b ON a.venue IS NOT DISTINCT FROM b.venue AND a.symbol IS NOT DISTINCT FROM b.symbol GROUP BY 1, 2""")
def ref_u1_u4_sets(s: SparkSession, d: str) -> DataFrame:
    """The union of two tables with different columns, for the pairs of names that both have."""
    left, right = table(s, d, "train_v1_dataset").select("venue", "symbol"), table(s, d, "funding_8h").select("venue", "symbol", F.col("funding_rate").alias("rate"))
    both = left.intersect(right.where("rate > 0").select("venue", "symbol")).select(F.col("venue").alias("_v"), F.col("symbol").alias("_s"))
    x = left.unionByName(right, allowMissingColumns=True)
    x = x.join(both, F.col("venue").eqNullSafe(F.col("_v")) & F.col("symbol").eqNullSafe(F.col("_s")))
    return x.groupBy("venue", "symbol").agg(F.count("*").alias("n"), F.count("rate").alias("n_rates"))


# --- further operators ---------------------------------------------------------------------------------------------------

@query("""SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close) AND isfinite(volume)) AS n_finite FROM features GROUP BY 1""")
def ref_p01_finite(s: SparkSession, d: str) -> DataFrame:
    """Rows with finite prices and volumes only."""
    ok = is_finite(F.col("open"))
    for c in ("high", "low", "close", "volume"):
        ok = ok & is_finite(F.col(c))
    return table(s, d, "features").groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("n_finite"))


@query("""SELECT 'min' AS which, CAST(min(epoch_us("timestamp")) AS BIGINT) AS us, count("timestamp") AS n FROM features UNION ALL SELECT 'max', CAST(max(epoch_us("timestamp")) AS BIGINT), count("timestamp") FROM features""")
def ref_t9_support(s: SparkSession, d: str) -> DataFrame:
    """First and last time of a table."""
    x = table(s, d, "features").agg(F.min(F.unix_micros("timestamp")).alias("a"), F.max(F.unix_micros("timestamp")).alias("b"), F.count("timestamp").alias("n"))
    return x.select(F.inline(F.array(*[F.struct(F.lit(k).alias("which"), F.col(c).alias("us"), F.col("n").alias("n")) for k, c in (("min", "a"), ("max", "b"))])))


@query(f"WITH {PANEL}, {FEATURES_SQL} SELECT instrument, count(*) AS n_rows, count(*) FILTER (WHERE log_ret_24 IS NOT NULL AND vol_roll IS NOT NULL AND ma_ratio IS NOT NULL AND log_ret_1_fwd IS NOT NULL) AS n_usable FROM feat GROUP BY 1")
def ref_p14_warm_up(s: SparkSession, d: str) -> DataFrame:
    """Rows left after warm-up and the last row are dropped."""
    f = features.bar_features(bars.panel_bars(s, d))
    use = features.usable_rows(f, ("log_ret_24", "vol_roll", "ma_ratio")).groupBy("instrument").agg(F.count("*").alias("u"))
    n = f.groupBy("instrument").agg(F.count("*").alias("n_rows"))
    return n.join(use, "instrument", "left").select("instrument", "n_rows", F.coalesce("u", F.lit(0)).alias("n_usable"))


@query(f"""WITH {PANEL}, {_RN} SELECT instrument, CASE WHEN rn < 50 THEN 'train' WHEN rn < 80 THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows, min(bar_s) AS first_s FROM x GROUP BY 1, 2""")
def ref_p18_o7_explicit_split(s: SparkSession, d: str) -> DataFrame:
    """Half-open ranges of row numbers."""
    return splits.explicit(bars.panel_bars(s, d), {"train": (0, 50), "val": (50, 80), "test": (80, None)}).groupBy("instrument", "split").agg(F.count("*").alias("n_rows"), F.min("bar_s").alias("first_s"))


@query("""WITH c AS (SELECT source, "timestamp" AS t, bar_id, row_number() OVER (PARTITION BY source, "timestamp" ORDER BY bar_id) AS k FROM features) SELECT source, count(*) AS n_kept, CAST(sum(bar_id) AS BIGINT) AS id_sum FROM c WHERE k = 1 GROUP BY 1""")
def ref_o1_o3_dedupe(s: SparkSession, d: str) -> DataFrame:
    """One row for each source and time, the first delivered; a minimum instead of a sort."""
    one = table(s, d, "features").groupBy("source", "timestamp").agg(F.min("bar_id").alias("bar_id"))
    return one.groupBy("source").agg(F.count("*").alias("n_kept"), F.sum("bar_id").alias("id_sum"))


@query(f"""WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bar_s DESC) AS z, row_number() OVER ({W_SQL}) AS a FROM bars)
SELECT instrument, bar_s, CASE WHEN a <= 3 THEN 'head' ELSE 'tail' END AS part, round(close, 6) + 0.0 AS close FROM k WHERE z > 1 AND (a <= 3 OR z <= 6)""")
def ref_o4_o8_tail(s: SparkSession, d: str) -> DataFrame:
    """Each instrument's bars without the last one: the first three and the last five of them."""
    z, a = F.row_number().over(Window.partitionBy("instrument").orderBy(F.col("bar_s").desc())), F.row_number().over(W.series("instrument"))
    x = bars.panel_bars(s, d).withColumns({"z": z, "a": a}).where((F.col("z") > 1) & ((F.col("a") <= 3) | (F.col("z") <= 6)))
    return rounded(x.select("instrument", "bar_s", F.when(F.col("a") <= 3, "head").otherwise("tail").alias("part"), "close"))


@query("""SELECT symbol FROM train_v1_dataset WHERE symbol IS NOT NULL EXCEPT SELECT symbol FROM funding_8h WHERE venue = 'vn0000' AND symbol IS NOT NULL""")
def ref_u3_difference(s: SparkSession, d: str) -> DataFrame:
    """Names of one table that another hasn't."""
    a = table(s, d, "train_v1_dataset").where(F.col("symbol").isNotNull()).select("symbol")
    return a.subtract(table(s, d, "funding_8h").where((F.col("venue") == "vn0000") & F.col("symbol").isNotNull()).select("symbol"))


@query(f"""WITH {PANEL}, {_RN}, y AS (SELECT *, CASE WHEN rn < floor(n * 0.8) THEN 'train' WHEN rn < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM x)
SELECT a.split AS a, b.split AS b, count(*) AS n_common FROM y a JOIN y b ON a.instrument = b.instrument AND a.bar_s = b.bar_s AND a.split < b.split GROUP BY 1, 2""")
def ref_u4_disjoint_splits(s: SparkSession, d: str) -> DataFrame:
    """Times that two splits share: none."""
    x = splits.chronological(bars.panel_bars(s, d), drop_last=False).groupBy("instrument", "bar_s").agg(F.array_sort(F.collect_set("split")).alias("k")).where(F.size("k") > 1)
    return x.groupBy(F.col("k")[0].alias("a"), F.col("k")[1].alias("b")).agg(F.count("*").alias("n_common"))


@query(f"""WITH {PANEL}, g AS (SELECT instrument, bar_s, CASE WHEN volume > 3 THEN close END AS x FROM bars)
SELECT instrument, bar_s, round(coalesce(last(x IGNORE NULLS) OVER ({W_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0), 6) + 0.0 AS filled FROM g""")
def ref_w17_forward_fill(s: SparkSession, d: str) -> DataFrame:
    """Missing values take the last known one, or 1 before the first."""
    x = bars.panel_bars(s, d).withColumn("x", F.when(F.col("volume") > 3, F.col("close")))
    return rounded(x.select("instrument", "bar_s", W.forward_fill(F.col("x"), W.series("instrument"), 1.0).alias("filled")))


@query(f"""WITH {PANEL}, {_LEDGER} SELECT policy, {_r("avg(pos) AS mean_action;stddev_pop(pos) AS std_action;avg(CASE WHEN abs(pos) > 0.95 THEN 1.0 ELSE 0.0 END) AS pct_saturated;avg(turnover) AS mean_turnover;avg(cost) AS mean_cost;avg(pnl_net) AS mean_pnl")} FROM led GROUP BY 1""")
def ref_a9_stability(s: SparkSession, d: str) -> DataFrame:
    """Aggregates of actions and costs that tell a dead policy."""
    return rounded(_trace(s, d).groupBy("policy").agg(F.avg("action").alias("mean_action"), F.stddev_pop("action").alias("std_action"), F.avg((F.abs("action") > 0.95).cast("double")).alias("pct_saturated"), F.avg("turnover").alias("mean_turnover"), F.avg("cost").alias("mean_cost"), F.avg("pnl_net").alias("mean_pnl")))


@query(f"""WITH {HOURLY}, {_LEDGER}, w AS (SELECT l.policy, l.instrument, v.k, l.pnl_net, l.turnover FROM led l, (VALUES (0), (1), (2)) v(k) WHERE l.t_index >= v.k * 256 AND l.t_index < v.k * 256 + 512),
m AS (SELECT instrument, policy, k, count(*) AS n, avg(pnl_net) / (stddev_pop(pnl_net) + 1e-12) * sqrt(2190.0) AS sh FROM w GROUP BY 1, 2, 3) SELECT policy, count(*) AS n_windows, {_r('quantile_cont(sh, 0.5) AS median;min(sh) AS worst;max(sh) AS best', 5)} FROM m WHERE n >= 20 AND policy <> 'flat' GROUP BY 1""")
def ref_a12_m17_validation_windows(s: SparkSession, d: str) -> DataFrame:
    """Scores over three overlapping validation windows of 512 hours, 256 apart: median, worst and best."""
    t = simulate.ledger(simulate.actions(bars.panel_bars(s, d, 3600))).where(F.col("policy") != "flat")
    k = F.filter(F.array(*[F.when((F.col("t_index") >= i * 256) & (F.col("t_index") < i * 256 + 512), F.lit(i)) for i in range(3)]), lambda x: x.isNotNull())
    m = t.withColumn("k", F.explode(k)).groupBy("instrument", "policy", "k").agg(F.count("*").alias("n"), (F.avg("pnl_net") / (F.stddev_pop("pnl_net") + 1e-12) * FREQ**0.5).alias("sh"))
    return rounded(m.where(F.col("n") >= 20).groupBy("policy").agg(F.count("*").alias("n_windows"), F.percentile("sh", F.lit(0.5)).alias("median"), F.min("sh").alias("worst"), F.max("sh").alias("best")), 5)


@query(f"WITH {_FUND} SELECT instrument, count(*) AS n, round(avg(funding_rate), 10) + 0.0 AS mean_rate, round(sum(funding_rate), 9) + 0.0 AS total_rate, CASE WHEN quantile_cont(funding_rate, 0.5) >= 0 THEN 'longs pay' ELSE 'shorts pay' END AS sign FROM fund GROUP BY 1")
def ref_e18_funding_summary(s: SparkSession, d: str) -> DataFrame:
    """Mean, total and usual sign of the funding rate."""
    f = bars.funding_events(s, d)
    return f.groupBy("instrument").agg(F.count("*").alias("n"), (F.round(F.avg("funding_rate"), 10) + 0.0).alias("mean_rate"), (F.round(F.sum("funding_rate"), 9) + 0.0).alias("total_rate"), F.when(F.percentile("funding_rate", F.lit(0.5)) >= 0, "longs pay").otherwise("shorts pay").alias("sign"))


@query(f"""WITH {PANEL}, {FEATURES_SQL}, {_LEDGER} SELECT led.instrument, policy, led.bar_s, {_r(';'.join(f'CAST(CAST({c} AS FLOAT) AS DOUBLE) AS o{i}' for i, c in enumerate(('feat.log_ret_24', 'feat.rsi', 'feat.ma_ratio', 'pos_prev', 'equity', 'drawdown'), 1)), 4)}
FROM led JOIN feat ON led.instrument = feat.instrument AND led.bar_s = feat.bar_s WHERE policy = 'random'""")
def ref_m9_observation(s: SparkSession, d: str) -> DataFrame:
    """The observation vector: market features, then the simulator's own state."""
    names = ("log_ret_24", "rsi", "ma_ratio")
    trace = simulate.ledger(simulate.actions(features.bar_features(bars.panel_bars(s, d)))).where(F.col("policy") == "random")
    o = simulate.observations(trace, names).select("instrument", "policy", "bar_s", *[F.col("obs")[i].cast("double").alias(f"o{i + 1}") for i in range(len(names) + 3)])
    return rounded(o, 4)


@query(f"""WITH {PANEL}, {_LEDGER} SELECT instrument, policy, bar_s, round(exp(sum(ln(1.0) + pos * ret_fwd - cost) OVER ({_PW})), 6) + 0.0 AS equity FROM s3""")
def ref_m11_positions_to_equity(s: SparkSession, d: str) -> DataFrame:
    """Equity of given positions, without funding or ruin."""
    t = simulate.ledger(simulate.actions(bars.panel_bars(s, d)), simulate.SimRules(ruin=-1.0))
    return rounded(t.select("instrument", "policy", "bar_s", "equity"))


@query("""SELECT bar_step, CAST(CASE bar_step WHEN '30m' THEN 0.5 WHEN '1h' THEN 1.0 WHEN '4h' THEN 4.0 WHEN '8h' THEN 8.0 END AS DOUBLE) AS hours, count(*) AS n FROM rl_observation_pack GROUP BY 1, 2""")
def ref_t4_interval_hours(s: SparkSession, d: str) -> DataFrame:
    """Interval texts as hours."""
    from barloom.functions.intervals import interval_hours
    from barloom.operators.gridding import step_seconds

    x = table(s, d, "rl_observation_pack").groupBy("bar_step", (step_seconds(F.col("bar_step")) / 3600.0).alias("hours")).agg(F.count("*").alias("n"))
    known = F.create_map(*[F.lit(v) for text in ("30m", "1h", "4h", "8h") for v in (text, interval_hours(text))])  # the driver's grammar
    return x.withColumn("hours", F.when(F.col("hours") == F.try_element_at(known, F.col("bar_step")), F.col("hours")))


@query("""SELECT raw_id, CAST(epoch_us(received_at) // 1000 AS BIGINT) AS ms, strftime(received_at, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM klines_raw WHERE received_at IS NOT NULL""")
def ref_t3_t7_epoch_ms(s: SparkSession, d: str) -> DataFrame:
    """Times as epoch milliseconds and as ISO-8601 texts."""
    t = F.col("received_at")
    return table(s, d, "klines_raw").where(t.isNotNull()).select("raw_id", F.unix_millis(t).alias("ms"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("""SELECT source, CAST(sum(CASE WHEN regexp_matches(lower(trim(source)), '^btc') THEN 1 ELSE 0 END) AS BIGINT) AS n_btc, any_value(upper(trim(symbol))) IS NOT NULL AS has_symbol FROM features GROUP BY 1""")
def ref_f4_strings(s: SparkSession, d: str) -> DataFrame:
    """Trimmed, lower-case and pattern-matched texts."""
    return table(s, d, "features").groupBy("source").agg(F.sum(F.lower(F.trim("source")).rlike("^btc").cast("bigint")).alias("n_btc"), F.max("symbol").isNotNull().alias("has_symbol"))


@query(f"""WITH {_DAYS}, {_FOLDS}, {_FOLD_ROWS}, bars AS (SELECT instrument || '#' || fold AS instrument, bar_s, close FROM fr WHERE split = 'test'), {_LEDGER.replace("instrument || '|' || bar_s", "split_part(instrument, '#', 1) || '|' || bar_s")}, {_METRICS},
z AS (SELECT CAST(split_part(instrument, '#', 2) AS INT) AS fold, policy, CASE WHEN n < 2 THEN 0 ELSE mu / (sd + 1e-12) * sqrt(365.0) END AS sharpe, CASE WHEN n < 2 THEN 0 ELSE max_dd END AS dd FROM m WHERE policy <> 'flat')
SELECT fold, policy, count(*) AS n, {_r('avg(sharpe) AS mean;stddev_pop(sharpe) AS std;quantile_cont(sharpe, 0.1) AS p10;quantile_cont(sharpe, 0.5) AS p50;quantile_cont(sharpe, 0.9) AS p90;max(dd) AS worst_dd', 5)} FROM z GROUP BY 1, 2""")
def ref_r12_fold_policy(s: SparkSession, d: str) -> DataFrame:
    """Folds and policies as group keys: the test metrics of each, and their summary over instruments."""
    test = splits.walk_forward(bars.daily_bars(s, d)).where(F.col("split") == "test").drop("rn", "n")
    t = simulate.ledger(simulate.actions(test, ("long", "short", "random")), keys=("instrument", "policy", "fold"))
    m = metrics.equity_metrics(t, ("instrument", "policy", "fold"), DAY_FREQ)
    return rounded(m.groupBy("fold", "policy").agg(F.count("*").alias("n"), F.avg("sharpe").alias("mean"), F.stddev_pop("sharpe").alias("std"), *[F.percentile("sharpe", F.lit(q)).alias(f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9)], F.max("max_dd").alias("worst_dd")), 5)


@query(f"""WITH {PANEL}, {_LEDGER}, x AS (SELECT instrument, policy, m AS multiplier, exp(sum(pnl_net - (m - 1) * cost)) - 1 AS c FROM led, (VALUES (0.0), (1.0), (2.0), (4.0)) t(m) GROUP BY 1, 2, 3)
SELECT CAST(multiplier AS DOUBLE) AS multiplier, {_r('quantile_cont(c, 0.5) AS median;quantile_cont(c, 0.1) AS p10;quantile_cont(c, 0.9) AS p90')} FROM x GROUP BY 1""")
def ref_a4_cost_summary(s: SparkSession, d: str) -> DataFrame:
    """Median and tails of the returns at each multiple of the costs."""
    c = robustness.cost_sensitivity(_trace(s, d), _KEYS, (0, 1, 2, 4), FREQ)
    return rounded(c.groupBy("multiplier").agg(*[F.percentile("cum_return", F.lit(q)).alias(k) for k, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))]))


@query(f"WITH {PANEL}, {_FUND}, lim AS (SELECT min(funding_s) AS lo FROM fund) SELECT instrument, count(*) AS n, min(bar_s) AS first_s FROM bars, lim WHERE bar_s >= lo GROUP BY 1")
def ref_p13_after_first_funding(s: SparkSession, d: str) -> DataFrame:
    """Bars from the first funding time on."""
    lo = bars.funding_events(s, d).agg(F.min("funding_s")).first()[0]
    return bars.panel_bars(s, d).where(F.col("bar_s") >= (lo if lo is not None else 0)).groupBy("instrument").agg(F.count("*").alias("n"), F.min("bar_s").alias("first_s"))
