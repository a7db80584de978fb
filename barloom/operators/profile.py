"""Column-level data quality profile.

Declared checks for all columns compile into one aggregate over one scan. Its result is a table of mergeable states (counts,
extremes and sketches of distinct values and of the distribution), so that files, loads or days profiled apart combine into the
same state as if they had been profiled together. A kept table of states is refreshed by reading new parts alone. Reports, control
limits and tests against other loads read only states.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import broadcast_if_small

STATE = ("n_rows", "n_null", "n_out", "n_bad", "distinct_state", "shape_state", "kind", "low", "high")


@dataclass(frozen=True)
class Check:
    """What values of a column must satisfy: numbers within [low, high], texts that match `pattern` as a whole."""

    low: float | None = None
    high: float | None = None
    pattern: str | None = None


@dataclass(frozen=True)
class Limits:
    """How far a load may lie from the usual value of the other loads."""

    null_points: float = 0.10
    distinct_ratio: float = 0.5
    shift: float = 0.25


def _number(c: Column, kind: T.DataType) -> Column | None:
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) / 1e6
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return None


def _within(x: Column, check: Check) -> Column:
    ok = ~F.isnan(x) & (F.abs(x) < float("inf"))
    if check.low is not None:
        ok = ok & (x >= check.low)
    if check.high is not None:
        ok = ok & (x <= check.high)
    return ok


def column_states(df: DataFrame, keys: Sequence[str], checks: Mapping[str, Check], columns: Sequence[str] | None = None, shape_k: int = 400) -> DataFrame:
    """One row of states for each group of `keys` and column: keys, column_name and STATE.

    n_out counts values outside a declared range, NaN and infinite ones included; n_bad counts texts that break the pattern.
    The distribution state holds the values within range, that of distinct values all but nulls. low and high are texts of the
    least and greatest value, compared as what kind says: `integer`, `number` or `text`. Key columns may be null and then form a group of their own; an empty table has no rows.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = [c for c in (columns or df.columns) if c not in keys and not isinstance(fields[c], (T.ArrayType, T.MapType, T.StructType))]
    by = [F.col(f"`{k}`") for k in keys]
    aggs, cells = [F.count("*").alias("n")], []
    for i, c in enumerate(names):
        col, check, kind = F.col(f"`{c}`"), checks.get(c, Check()), fields[c]
        x = _number(col, kind)
        text = col if isinstance(kind, T.StringType) else None
        good = _within(x, check) if x is not None else F.lit(False)
        nan = F.isnan(col) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False)
        real = F.when(col.isNotNull() & ~nan, col)
        aggs += [
            F.count(col).alias(f"n_{i}"),
            F.count_if(col.isNotNull() & ~good).alias(f"o_{i}") if x is not None else F.lit(0).cast("bigint").alias(f"o_{i}"),
            F.count_if(~text.rlike(rf"^(?:{check.pattern})\z")).alias(f"b_{i}") if text is not None and check.pattern else F.lit(0).cast("bigint").alias(f"b_{i}"),
            F.hll_sketch_agg(col.cast("string") if text is None else col, F.lit(12)).alias(f"d_{i}"),
            F.kll_sketch_agg_double(F.when(good, x), F.lit(shape_k)).alias(f"s_{i}") if x is not None else F.lit(None).cast("binary").alias(f"s_{i}"),
            F.min(real).cast("string").alias(f"l_{i}"),
            F.max(real).cast("string").alias(f"h_{i}"),
        ]
        order = "integer" if isinstance(kind, T.IntegralType) else "number" if isinstance(kind, T.NumericType) else "text"
        get = lambda p: F.col(f"{p}_{i}")  # noqa: B023, E731
        cells.append(F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), (F.col("n") - get("n")).alias("n_null"), get("o").alias("n_out"), get("b").alias("n_bad"), get("d").alias("distinct_state"), get("s").alias("shape_state"), F.lit(order).alias("kind"), get("l").alias("low"), get("h").alias("high")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def merge_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of parts combined to those of the coarser groups `keys`, the same as if the parts had been read together (sketches
    within their error). Extremes are compared as whole numbers, numbers or texts, by the column's kind."""
    by = lambda c: F.struct(F.when(F.col("kind") == "integer", F.col(c).try_cast("decimal(38,0)")), F.when(F.col("kind") == "number", F.col(c).try_cast("double")), F.when(F.col("kind") == "text", F.col(c)))
    some = lambda c: F.when(F.col(c).isNotNull(), by(c))
    return states.groupBy(*[F.col(f"`{k}`") for k in keys], "column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.sum("n_out").alias("n_out"), F.sum("n_bad").alias("n_bad"),
        F.hll_union_agg("distinct_state").alias("distinct_state"), F.kll_merge_agg_double("shape_state").alias("shape_state"),
        F.first("kind").alias("kind"), F.min_by("low", some("low")).alias("low"), F.max_by("high", some("high")).alias("high"),
    )


def refresh_states(df: DataFrame, known: DataFrame | None, part: str, keys: Sequence[str], checks: Mapping[str, Check], columns: Sequence[str] | None = None, listed: int = 10_000) -> DataFrame:
    """`known`, states of earlier parts by (part, keys), with those of the parts of df that it lacks.

    part: the column that tells parts, such as files or loads, which are complete once they are known. New parts are found from
    that column alone; up to `listed` of them become a filter of the scan, so that only they are read, more of them a join. Null
    parts are read again each time and not kept."""
    new = df.where(F.col(part).isNotNull())
    if known is not None:
        lacking = new.select(part).distinct().join(known.select(part).distinct(), part, "left_anti")
        some = [r[0] for r in lacking.limit(listed + 1).collect()]
        new = new.where(F.col(part).isin(some)) if len(some) <= listed else new.join(broadcast_if_small(lacking, 100_000), part, "left_semi")
    states = column_states(new, [part, *keys], checks, columns)
    return states if known is None else known.unionByName(states)


def control_limits(compared: DataFrame, group: str, load: str, metric: str, width: float = 3.0, least: int = 2) -> DataFrame:
    """compared with `<metric>_low`, `<metric>_high`: mean of the group's earlier loads, less and plus `width` deviations, and
    `<metric>_out`, whether a load lies outside. Null while there are fewer than `least` earlier loads."""
    w = Window.partitionBy(group, "column_name").orderBy(load).rowsBetween(Window.unboundedPreceding, -1)
    enough = F.count(metric).over(w) >= least
    mean, spread = F.avg(metric).over(w), F.stddev_pop(metric).over(w)
    out = compared.withColumns({f"{metric}_low": F.when(enough, mean - width * spread), f"{metric}_high": F.when(enough, mean + width * spread)})
    return out.withColumn(f"{metric}_out", (F.col(metric) < F.col(f"{metric}_low") - 1e-12) | (F.col(metric) > F.col(f"{metric}_high") + 1e-12))


def _median_of_others(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """df with the median of `value` over the other rows of its group, from the three middle values of the sorted group."""
    w, sort = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last(), "load_id")
    x = df.withColumns({"_r": F.row_number().over(sort), "_p": F.count(value).over(w)})
    h = F.when(F.col("_p") % 2 == 0, F.col("_p") / 2).otherwise((F.col("_p") - 1) / 2).cast("int")
    x = x.withColumn("_h", h)
    x = x.withColumns({f"_m{k}": F.max(F.when(F.col("_r") == F.col("_h") + k, F.col(value))).over(w) for k in (0, 1, 2)})
    at = lambda k: F.when(F.col("_r") > F.col("_h") + k, F.col(f"_m{k}")).otherwise(F.col(f"_m{k + 1}"))
    usual = F.when(F.col("_p") < 2, None).when(F.col("_p") % 2 == 0, at(0)).otherwise((at(0) + at(1)) / 2)
    return x.withColumn(out, usual).drop("_r", "_p", "_h", "_m0", "_m1", "_m2")


def compare_loads(states: DataFrame, group: str, load: str, limits: Limits = Limits(), points: int = 40, steps: int = 100) -> DataFrame:
    """States with each load's metrics and what is usual in the other loads of its group.

    null_share, usual_null_share; distinct_share (different values for each value), usual_distinct_share; shifted_from: of the
    group's other loads, the share whose distribution differs at one point by more than limits.shift in the share of values at
    or below it, the greatest over all points. The points are quantiles of the group's merged distribution, at which each
    distribution is read from `steps` of its own quantiles. No load is paired with another: for each point, a range frame over
    the loads ordered by their share counts those that lie near. A group of one load has null for what is usual.
    """
    s = states.withColumnRenamed(load, "load_id").withColumn("n_values", F.col("n_rows") - F.col("n_null"))
    s = s.withColumns({"null_share": F.col("n_null") / F.col("n_rows"), "distinct_share": F.try_divide(F.hll_sketch_estimate("distinct_state").cast("double"), F.col("n_values"))})
    s = _median_of_others(s, [group, "column_name"], "null_share", "usual_null_share")
    s = _median_of_others(s, [group, "column_name"], "distinct_share", "usual_distinct_share")
    even = lambda n: F.array(*[F.lit((i + 0.5) / n) for i in range(n)])
    shaped = s.where(F.col("shape_state").isNotNull() & (F.kll_sketch_get_n_double("shape_state") > 0)).select(group, "column_name", "load_id", "shape_state")
    pooled = shaped.groupBy(group, "column_name").agg(F.kll_merge_agg_double("shape_state").alias("_all"), F.count("*").alias("_loads"))
    pooled = pooled.where(F.col("_loads") > 1).select(group, "column_name", "_loads", F.array_distinct(F.kll_sketch_get_quantile_double("_all", even(points))).alias("_at"))
    own = shaped.select(group, "column_name", "load_id", F.kll_sketch_get_quantile_double("shape_state", even(steps)).alias("_own")).join(pooled, [group, "column_name"])
    shares = F.transform("_at", lambda x: F.size(F.filter("_own", lambda v: v <= x)))
    ranks = own.select(group, "column_name", "load_id", "_loads", F.posexplode(shares).alias("_i", "_share"))
    near = F.count("*").over(Window.partitionBy(group, "column_name", "_i").orderBy("_share").rangeBetween(-int(limits.shift * steps), int(limits.shift * steps)))
    far = ranks.withColumn("_far", (F.col("_loads") - near) / (F.col("_loads") - 1)).groupBy(group, "column_name", "load_id").agg(F.max("_far").alias("shifted_from"))
    return s.join(far, [group, "column_name", "load_id"], "left").withColumnRenamed("load_id", load)


def findings(compared: DataFrame, load: str, checks: Mapping[str, Check], limits: Limits = Limits(), shape: Sequence[str] | None = None) -> DataFrame:
    """(load, column_name, finding) for each column of `checks` that falls out of line in a load.

    `nulls`, `range`, `distinct`, `shift`, `pattern`; distinct and shift only for the columns named in `shape` (default: those
    with a range). Loads without others to compare with are tested for range and pattern alone.
    """
    shape = list(shape if shape is not None else [c for c, k in checks.items() if k.pattern is None])
    ranged = [c for c, k in checks.items() if k.low is not None or k.high is not None]
    patterned = [c for c, k in checks.items() if k.pattern is not None]
    has = lambda names: F.col("column_name").isin(*names) if names else F.lit(False)
    tests = {
        "nulls": F.col("null_share") > F.col("usual_null_share") + limits.null_points,
        "range": has(ranged) & (F.col("n_out") > 0),
        "distinct": has(shape) & (F.col("distinct_share") < F.col("usual_distinct_share") * limits.distinct_ratio),
        "shift": has(shape) & (F.col("shifted_from") > 0.5),
        "pattern": has(patterned) & (F.col("n_bad") > 0),
    }
    found = F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]), lambda x: x.isNotNull())
    return compared.where(has(list(checks))).select(load, "column_name", F.explode(found).alias("finding"))
