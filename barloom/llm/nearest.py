"""Matching records of two tables by nearest time within a tolerance.

Tick expansion: each right record is written to every tick of time its tolerance reaches. A tick keeps, for each entity, the
last record before it, the first after it and those inside it; left records then meet their own tick by an equi-join. Keys are
(entity, tick), so an entity with a third of all rows is spread over its ticks, and no two records of an entity are paired only
because they share it. Ticks with many records inside are resolved by an ordered pass instead of a list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_by_time(left: DataFrame, right: DataFrame, entity: Sequence[str], left_id: str, right_id: str, time_col: str = "timestamp", values: Sequence[str] = (), tolerance_s: float = 1800.0, tick_s: float = 300.0, dense: int = 256, keep: Sequence[str] | None = None) -> DataFrame:
    """(left_id, right_id, distance_us, values...): for each left record the nearest right record of its entity, before or after.

    At most tolerance_s away, both ends included; of equally near records that with the smaller right_id. Records with a null
    entity column or time, and right records with a null value, take no part. Right records of one entity and time count as the
    one with the smallest id. A left record without a partner has no row; left ids are taken to be unique. keep: columns of left
    to carry along; then every left record has a row (a left join), with nulls where it has no partner. dense: records inside a
    tick from which it is resolved by order; this changes the plan for the tick, never the result.
    """
    tol, tick = int(tolerance_s * 1_000_000), int(tick_s * 1_000_000)
    keys = [f"_e{i}" for i in range(len(entity))]
    number = lambda us: F.expr(f"({us} - pmod({us}, {tick})) div {tick}")
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(entity, keys)]

    extra = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep or ())]
    carry = [f"_k{i}" for i in range(len(extra))]
    fit = F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in (*entity, time_col)))
    lhs = left.where(fit).select(F.col(f"`{left_id}`").alias("_lid"), *named, F.unix_micros(F.col(f"`{time_col}`")).alias("_us"), *extra).withColumn("_tick", number("_us"))
    rhs = right.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in (*entity, time_col, right_id, *values)))).select(F.col(f"`{right_id}`").alias("_rid"), *named, F.unix_micros(F.col(f"`{time_col}`")).alias("_at"), *[F.col(f"`{v}`").alias(f"_v{i}") for i, v in enumerate(values)])
    event = ["_at", "_rid", *[f"_v{i}" for i in range(len(values))]]
    rhs = rhs.groupBy(*keys, "_at").agg(F.min("_rid").alias("_rid"), *[F.min_by(f"_v{i}", "_rid").alias(f"_v{i}") for i in range(len(values))]).withColumn("_own", number("_at"))
    rhs = rhs.withColumn("_dense", F.count("*").over(Window.partitionBy(*keys, "_own")) > dense)

    spread = rhs.withColumn("_tick", F.explode(F.sequence(number(f"(_at - {tol})"), number(f"(_at + {tol})"))))
    cell = F.struct(*event)
    ticks = spread.groupBy(*keys, "_tick").agg(
        F.max_by(cell, F.when(F.col("_own") < F.col("_tick"), F.col("_at"))).alias("_before"),
        F.min_by(cell, F.when(F.col("_own") > F.col("_tick"), F.col("_at"))).alias("_after"),
        F.collect_list(F.when((F.col("_own") == F.col("_tick")) & ~F.col("_dense"), cell)).alias("_inside"),
        F.coalesce(F.bool_or((F.col("_own") == F.col("_tick")) & F.col("_dense")), F.lit(False)).alias("_full"),
    )
    met = lhs.join(ticks, [*keys, "_tick"], "inner" if keep is None else "left")
    near = lambda c: F.struct(F.abs(c["_at"] - F.col("_us")).alias("d"), *[c[e].alias(e) for e in ("_rid", *event[2:])])
    some = F.filter(F.concat(F.array("_before", "_after"), F.col("_inside")), lambda c: c.isNotNull())
    best = met.select("_lid", *carry, F.array_min(F.transform(some, near)).alias("_best"))

    # Ticks with many records inside: left and right records in one order, each left record sees the last before and the first after it.
    none = [F.lit(None).cast(rhs.schema[e].dataType).alias(e) for e in event[1:]]
    full = ticks.where("_full").select(*keys, "_tick")
    a = lhs.join(full, [*keys, "_tick"], "left_semi").select(*keys, "_tick", "_lid", F.col("_us").alias("_at"), *none, F.lit(1).alias("_side"))
    b = rhs.where("_dense").select(*keys, F.col("_own").alias("_tick"), F.lit(None).cast(lhs.schema["_lid"].dataType).alias("_lid"), *event, F.lit(0).alias("_side"))  # the columns carried along come with the other rows
    w = Window.partitionBy(*keys, "_tick")
    seen = F.when(F.col("_side") == 0, F.struct(*event))
    passed = a.unionByName(b).withColumns({
        "_x": F.last(seen, True).over(w.orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)),
        "_y": F.last(seen, True).over(w.orderBy(F.col("_at").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)),
    }).where("_side = 1").withColumnRenamed("_at", "_us")
    more = passed.select("_lid", F.array_min(F.transform(F.filter(F.array("_x", "_y"), lambda c: c.isNotNull()), near)).alias("_best"))
    both = best.unionByName(more, allowMissingColumns=True)
    close = F.min(F.when(F.col("_best.d") <= tol, F.col("_best")))
    both = both.groupBy("_lid").agg(close.alias("_best"), *[F.first(c, True).alias(c) for c in carry])
    if keep is None:
        both = both.where(F.col("_best").isNotNull())
    else:
        loose = left.where(~F.coalesce(fit, F.lit(False))).select(F.col(f"`{left_id}`").alias("_lid"), *extra)
        both = both.unionByName(loose, allowMissingColumns=True)
    return both.select(F.col("_lid").alias(left_id), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep or ())], F.col("_best._rid").alias(right_id), F.col("_best.d").alias("distance_us"), *[F.col(f"_best._v{i}").alias(v) for i, v in enumerate(values)])
