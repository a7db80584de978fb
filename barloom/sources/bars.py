"""Bars: regular OHLCV tables from event and order tables.

A bar table has instrument, bar_s (start in seconds since 1970), open, high, low, close, volume. Its rows per instrument are
bounded by time range over step, not by the number of events, so windows over one instrument stay small at any data size; the
events themselves are only aggregated, with map-side partial states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.numeric import is_finite
from barloom.sources.tables import table

BAR = ("instrument", "bar_s", "open", "high", "low", "close", "volume")


def tumbling_bars(df: DataFrame, instrument: Column, ts: Column, value: Column, order: Column, step_s: int) -> DataFrame:
    """OHLCV of the positive finite values in each period of step_s seconds; volume is their number."""
    v = df.select(instrument.alias("instrument"), ts.cast("timestamp").alias("_ts"), value.cast("double").alias("_v"), order.alias("_k")).where(is_finite(F.col("_v")) & (F.col("_v") > 0) & F.col("_ts").isNotNull())
    v = v.withColumn("bar_s", (F.floor(F.unix_seconds("_ts") / step_s) * step_s).cast("bigint"))
    at = F.struct("_ts", "_k")
    return v.groupBy("instrument", "bar_s").agg(F.min_by("_v", at).alias("open"), F.max("_v").alias("high"), F.min("_v").alias("low"), F.max_by("_v", at).alias("close"), F.count("*").cast("double").alias("volume"))


def panel_bars(spark: SparkSession, d: str, step_s: int = 14_400) -> DataFrame:
    """Bars of each event_type."""
    e = table(spark, d, "events")
    return tumbling_bars(e, F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"), step_s)


def market_bars(spark: SparkSession, d: str, step_s: int = 14_400) -> DataFrame:
    """Bars of all events as one market."""
    e = table(spark, d, "events")
    return tumbling_bars(e, F.lit("ALL"), F.col("ts"), F.col("value"), F.col("event_id"), step_s)


def daily_bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of each order priority."""
    o = table(spark, d, "orders")
    return tumbling_bars(o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), 86_400)


def funding_events(spark: SparkSession, d: str) -> DataFrame:
    """instrument, funding_s, funding_rate: 8h averages stamped at the end of their period, so that they are known then."""
    e = table(spark, d, "events").where(is_finite(F.col("value").cast("double")))
    bucket = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 28_800) * 28_800 + 28_800).cast("bigint")
    return e.groupBy(F.col("event_type").alias("instrument"), bucket.alias("funding_s")).agg(((F.avg("value") - 50) / 100_000).alias("funding_rate"))


def load_ohlcv(df: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Clean OHLCV rows: parsed time, finite numbers, one row for each key and time (that with the smallest order)."""
    t = F.col(f"`{ts}`") if dict(df.dtypes)[ts].startswith("timestamp") else F.col(f"`{ts}`").try_cast("timestamp")
    numbers = ["open", "high", "low", "close", "volume"]
    rows = df.select(F.col(f"`{key}`").alias("instrument"), F.unix_micros(t).alias("us"), *[F.col(c).try_cast("double").alias(c) for c in numbers], F.col(f"`{order}`").alias("_o"))
    for c in numbers:
        rows = rows.where(is_finite(F.col(c)))
    rows = rows.where(F.col("us").isNotNull() & F.col("instrument").isNotNull())
    return rows.groupBy("instrument", "us").agg(*[F.min_by(c, "_o").alias(c) for c in numbers])


def klines_to_ohlcv(raw: DataFrame, instants: Column, key: str) -> DataFrame:
    """Raw kline rows with text prices, their parsed instants given, as clean OHLCV rows."""
    return load_ohlcv(raw.withColumn("_at", F.timestamp_micros(instants)), key, "_at", "raw_id")
