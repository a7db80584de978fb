"""Bars from an event stream: the batch bars' rules with event-time windows and a watermark for late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import is_finite


def streaming_bars(events: DataFrame, instrument: Column, ts: Column, value: Column, order: Column, step: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """OHLCV of the positive finite values in each tumbling window; a window closes when the watermark has passed it.

    Null times and values that aren't positive and finite take no part; rows later than `late` behind the newest are dropped by
    the watermark. Ties in time are settled by `order`, as in tumbling_bars."""
    v = events.select(instrument.alias("instrument"), ts.cast("timestamp").alias("_ts"), value.cast("double").alias("_v"), order.alias("_k"))
    v = v.where(is_finite(F.col("_v")) & (F.col("_v") > 0) & F.col("_ts").isNotNull()).withWatermark("_ts", late)
    at = F.struct("_ts", "_k")
    bars = v.groupBy("instrument", F.window("_ts", step)).agg(F.min_by("_v", at).alias("open"), F.max("_v").alias("high"), F.min("_v").alias("low"), F.max_by("_v", at).alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("instrument", F.unix_seconds("window.start").alias("bar_s"), "open", "high", "low", "close", "volume")
