"""Joins of slower series and packs to bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: Sequence[str], chunk: int = 1 << 22, strict: bool = False) -> DataFrame:
    """left with the values of the latest right row of its key at or before its time; nulls where there is none.

    Both sides are unioned and ordered within (key, chunk of time), right before left at equal times; what a chunk has to know
    of earlier ones is the last right row before it, one row for each chunk. A key with a third of all rows is thus many groups.
    Of right rows with equal time the one with the greatest values counts. Left rows with a null key or time get nulls. strict: raise
    when a left row stays without partner.
    """
    number = lambda c: F.floor(F.col(c) / chunk).cast("bigint")
    own = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).groupBy(key, F.col(right_at).alias("_at")).agg(F.max(F.struct(*values)).alias("_v")).withColumn("_chunk", number("_at"))
    names = [c for c in left.columns]
    rows = left.withColumns({"_at": F.col(left_at), "_chunk": number(left_at)})
    # The last right row of each chunk, carried to every later chunk that has rows.
    chunks = own.groupBy(key, "_chunk").agg(F.max_by("_v", "_at").alias("_last")).unionByName(rows.select(key, "_chunk").distinct(), allowMissingColumns=True)
    chunks = chunks.groupBy(key, "_chunk").agg(F.first("_last", True).alias("_last"))
    before = F.last("_last", True).over(Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    carried = chunks.select(key, "_chunk", before.alias("_v")).where(F.col("_v").isNotNull())
    events = own.select(key, "_chunk", "_at", "_v", F.lit(1).alias("_side")).unionByName(carried.select(key, "_chunk", F.lit(None).cast(dict(rows.dtypes)["_at"]).alias("_at"), "_v", F.lit(0).alias("_side")))
    both = rows.withColumn("_side", F.lit(2)).unionByName(events, allowMissingColumns=True)
    w = Window.partitionBy(key, "_chunk").orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last(F.when(F.col("_side") < 2, F.col("_v")), True).over(w)).where(F.col("_side") == 2)
    out = seen.select(*names, *[F.when(F.col(key).isNotNull() & F.col("_at").isNotNull(), F.col(f"_seen.{v}")).alias(v) for v in values])
    if strict and (missing := out.where(F.col(values[0]).isNull()).count()):
        raise ValueError(f"{missing} rows without a value at or before their time")
    return out


def attach_funding(bars: DataFrame, funding: DataFrame, scale_hours: float = 8.0, strict: bool = False) -> DataFrame:
    """Bars with funding_rate_1h_scaled, the latest known rate for each hour."""
    out = asof_backward(bars, funding, "instrument", "bar_s", "funding_s", ["funding_rate"], strict=strict)
    return out.withColumn("funding_rate_1h_scaled", F.col("funding_rate") / scale_hours).drop("funding_rate")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def exact_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", one_to_one: bool = True) -> DataFrame:
    """An equi-join on exact keys; raises when one_to_one and a key is repeated on either side."""
    if one_to_one:
        for name, df in (("left", left), ("right", right)):
            if duplicate_keys(df, keys).limit(1).count():
                raise ValueError(f"repeated keys on the {name}")
    return left.join(right, list(keys), how)


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys), list(keys), "left_anti")


def trim_to_support(df: DataFrame, other: DataFrame, at: str, other_at: str | None = None) -> DataFrame:
    """Rows within the time range that `other` covers, both ends included; the range is one row."""
    span = other.agg(F.min(other_at or at).alias("lo"), F.max(other_at or at).alias("hi")).first()
    return df.where(F.col(at).between(span["lo"], span["hi"])) if span["lo"] is not None else df.limit(0)


def merge_regime(bars: DataFrame, pack: DataFrame, strict: bool = True, how: str = "inner", one_to_one: bool = True) -> DataFrame:
    """Bars with their regime columns: trimmed to the pack's range, joined on exact time; one_to_one raises on repeated keys, strict
    on bars without a row."""
    trimmed = trim_to_support(bars, pack, "bar_s")
    out = exact_join(trimmed, pack, ["instrument", "bar_s"], how, one_to_one)
    if strict and (n := unmatched(trimmed, pack, ["instrument", "bar_s"]).count()):
        raise ValueError(f"{n} bars without a regime row")
    return out
