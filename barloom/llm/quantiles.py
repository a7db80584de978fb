"""Percentiles of very large numeric columns with a bounded rank error.

The state of a group is a hierarchy of randomized compactors: each level holds a sorted buffer, which when full keeps every
second value, from a random start, and hands them to the next level at twice the weight. States of days or partitions merge level
by level, so a day is read once and every coarser percentile comes from states alone. The JVM's KLL aggregate is such a
hierarchy, so states are built map-side inside the aggregation, and a hot group is no single task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = (0.01, 0.05, 0.10, 0.50, 0.90, 0.95, 0.99)


def rank_error(k: int) -> float:
    """The published bound on the rank error of one percentile, as a share of the values, kept with 99 % probability."""
    return 2.296 / k**0.9021


def usable(value: Column) -> Column:
    """The value unless it is null, NaN or infinite."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def once_per_run(df: DataFrame, run: str, row: str, keep: Sequence[str]) -> DataFrame:
    """One row for each run: that with the smallest row id. Rows without a run id count each by themselves."""
    own = F.when(F.col(run).isNull(), F.col(row))
    first = df.groupBy(F.col(run).alias("_run"), own.alias("_own")).agg(F.min_by(F.struct(*keep), F.col(row)).alias("_first"))
    return first.select("_first.*")


def day_states(df: DataFrame, day: Column, keys: Sequence[str], metrics: Sequence[str], k: int = 2048) -> DataFrame:
    """Keys, day and the state of each metric for each day and group. A group without usable values has an empty state."""
    return df.groupBy(day.alias("day"), *[F.col(f"`{c}`") for c in keys]).agg(*[F.kll_sketch_agg_double(usable(F.col(f"`{m}`").cast("double")), F.lit(k)).alias(m) for m in metrics])


def merge_states(states: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """States of coarser groups from those of finer ones."""
    return states.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(*[F.kll_merge_agg_double(m).alias(m) for m in metrics])


def percentiles(states: DataFrame, keys: Sequence[str], metrics: Sequence[str], k: int = 2048, points: Sequence[float] = POINTS) -> DataFrame:
    """Keys, metric, n, the percentiles (p01 .. p99) and rank_error, for each group and metric.

    A percentile is a value of the group whose rank, as a share of n, is off by at most rank_error; groups of at most k values
    are exact and have 0. Groups without usable values have n = 0 and null percentiles.
    """
    names = [f"p{round(p * 100):02d}" for p in points]
    long = states.select(*[F.col(f"`{c}`") for c in keys], F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("_state")) for m in metrics])))
    long = long.withColumn("n", F.coalesce(F.kll_sketch_get_n_double("_state"), F.lit(0)).cast("bigint"))
    long = long.withColumn("_q", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_state", F.array(*[F.lit(float(p)) for p in points]))))
    return long.select(*[F.col(f"`{c}`") for c in keys], "metric", "n", *[F.col("_q").getItem(i).alias(n) for i, n in enumerate(names)], F.when(F.col("n") <= k, 0.0).otherwise(rank_error(k)).alias("rank_error"))
