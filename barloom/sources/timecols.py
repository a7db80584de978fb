"""Time columns of tables that name and encode them in their own ways."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of time columns, in the order of preference.
CANDIDATES = ("timestamp", "date", "open_time", "close_time", "datetime", "funding_time_utc", "fundingTime")
REPORT_CANDIDATES = ("timestamp", "datetime", "date", "time")


def time_column(names: Sequence[str], candidates: Sequence[str] = CANDIDATES) -> str:
    """The first candidate among the names; raises when there is none."""
    for c in candidates:
        if c in names:
            return c
    raise ValueError(f"no time column among {list(names)}")


def epoch_unit(median: float | None) -> str:
    """The unit of epoch numbers, told from their median: `ns`, `ms` or `s`."""
    if median is None or median > 1e14:
        return "ns"
    return "ms" if median > 1e11 else "s" if median > 1e9 else "ns"


def with_timestamp(df: DataFrame, candidates: Sequence[str] = CANDIDATES, keys: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """df with its time column as `timestamp` (UTC), without rows whose time can't be read, one row for each key and time.

    Numbers are epoch counts whose unit follows from their median (an approximate one, which the unit's powers of a thousand
    forgive). Of rows of one key and time the one with the smallest `order` stays; without `order` all stay.
    """
    name = time_column(df.columns, candidates)
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        unit = epoch_unit(df.agg(F.percentile_approx(c.cast("double"), 0.5, 1000)).first()[0])
        n = F.floor(c.cast("decimal(38,6)") * {"ns": 1, "ms": 1000, "s": 1_000_000}[unit] / (1000 if unit == "ns" else 1)).try_cast("bigint")
        at = F.timestamp_micros(n)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = c.cast("timestamp")
    else:
        at = c.try_cast("timestamp")
    out = df.withColumn("_at", at).drop(name).withColumnRenamed("_at", "timestamp").where(F.col("timestamp").isNotNull())
    if order is None:
        return out
    rest = [x for x in out.columns if x not in (*keys, "timestamp")]
    first = out.groupBy(*keys, "timestamp").agg(F.min_by(F.struct(*[F.col(f"`{x}`") for x in rest]), F.col(f"`{order}`")).alias("_row"))
    return first.select(*keys, "timestamp", "_row.*")
