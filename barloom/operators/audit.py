"""Audits of tables: reports, gaps, digests, pack checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.numeric import is_finite
from barloom.operators import windows as W
from barloom.operators.quantiles import exact_percentiles
from barloom.session import cut_lineage


def data_report(df: DataFrame, key: str, at: str, step_s: int, value: str, tolerance: float = 1e-6) -> DataFrame:
    """rows, time range, repeated times, gaps, greatest gap, distances that differ from step_s by more than `tolerance` of it, values that
    aren't finite, and quantiles of `value`, for each key."""
    w = Window.partitionBy(key).orderBy(at)
    x = df.withColumn("_gap", F.col(at) - F.lag(at).over(w))
    v = F.when(is_finite(F.col(value).cast("double")), F.col(value).cast("double"))
    return x.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(at).alias("first_s"), F.max(at).alias("last_s"), F.count_if(F.col("_gap") == 0).alias("n_repeated"), F.count_if(F.col("_gap") > step_s).alias("n_gaps"), F.max("_gap").alias("max_gap_s"), F.count_if(F.abs(F.col("_gap") - step_s) > tolerance * step_s).alias("n_off_step"), F.count_if(~is_finite(F.col(value).cast("double"))).alias("n_not_finite"), *[F.percentile(v, F.lit(q)).alias(f"p{round(q * 100):02d}") for q in (0.01, 0.5, 0.99)])


def gap_rows(df: DataFrame, key: str, at: str, step_s: int) -> DataFrame:
    """Rows that don't follow the one before by step_s, with the distance."""
    w = Window.partitionBy(key).orderBy(at)
    return df.select(key, at, W.gaps(F.col(at), w, step_s).alias("gap_s")).where(F.col("gap_s").isNotNull())


def null_shares(df: DataFrame) -> DataFrame:
    """(column_name, null_share) of each column; NaN counts as null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    bad = lambda c: F.col(f"`{c}`").isNull() | (F.isnan(F.col(f"`{c}`")) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.lit(False))
    one = df.agg(*[F.avg(bad(c).cast("double")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("null_share")) for i, c in enumerate(df.columns)])).alias("x")).select("x.*")


def frame_report(df: DataFrame) -> DataFrame:
    """(position, column_name, type, n_rows, n_null) of each column, from one scan; NaN isn't null here."""
    one = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(t).alias("type"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{i}")).alias("n_null")) for i, (c, t) in enumerate(df.dtypes)]
    return one.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n): how often each value of the columns occurs, as texts; null is a value."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(cells).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def digest(df: DataFrame) -> DataFrame:
    """(n_rows, digest): a hash of the content that doesn't depend on the order of rows."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def probability_sums(df: DataFrame, key: str, columns: list[str], tolerance: float = 1e-4) -> DataFrame:
    s = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.withColumn("_s", s).groupBy(key).agg(F.avg("_s").alias("mean_sum"), F.min("_s").alias("min_sum"), F.max("_s").alias("max_sum"), F.count_if(F.abs(F.col("_s") - 1) > tolerance).alias("n_off"))


def chunked_gaps(df: DataFrame, key: str, at: str, chunk: int) -> DataFrame:
    """(key, at, gap) of the rows with a time: the distance to the row before. Rows are ordered within chunks of time; the last time of a
    chunk is carried to the next one that has rows, so no key is ordered as a whole."""
    x = df.where(F.col(at).isNotNull()).select(key, at).withColumn("_c", F.expr(f"({at} - pmod({at}, {chunk})) div {chunk}"))
    ends = x.groupBy(key, "_c").agg(F.max(at).alias("_end"))
    ends = ends.select(F.col(key).alias("_key"), F.col("_c").alias("_d"), F.lag("_end").over(Window.partitionBy(key).orderBy("_c")).alias("_prev"))
    x = x.withColumn("_in", F.lag(at).over(Window.partitionBy(key, "_c").orderBy(at)))
    x = x.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_c") == F.col("_d")))
    return x.select(key, at, (F.col(at) - F.coalesce("_in", "_prev")).alias("gap"))


def pack_report(df: DataFrame, key: str, at: str, chunk: int = 86_400_000_000) -> DataFrame:
    """Rows, distinct and repeated times and the extremes and median of the gaps between them, for each key. Null times don't count;
    null keys are one key."""
    x = cut_lineage(chunked_gaps(df, key, at, chunk))
    gaps = x.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if(F.col("gap") == 0).alias("n_repeated"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))
    middle = exact_percentiles(x, [key], F.col("gap"), (0.5,), ("median_gap",)).select(F.col(key).alias("_key"), "median_gap")
    out = gaps.join(middle, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(key, "n_rows", (F.col("n_rows") - F.col("n_repeated")).alias("n_distinct"), "n_repeated", "min_gap", "max_gap", "median_gap")
