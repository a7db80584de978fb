"""Exact percentiles of groups of any size.

A mergeable sketch of a group brackets each wanted rank; a pass counts the values below the bracket and sketches those inside, until
so few are left that they can be put in order. Every pass is a map-side aggregate; no group is sorted or collected as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import broadcast_if_small, cut_lineage

#: Compactor size, and the share of ranks by which a bracket reaches beyond the sketch's answer: three times its error at 99 %.
K, REACH = 4096, 3 * 2.296 / 4096**0.9021
#: Steps of the ranks at which a sketch is asked.
GRID = 400


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, points: Sequence[float], names: Sequence[str], few: int = 1_000_000, rounds: int = 8) -> DataFrame:
    """keys, n and for each point the percentile, interpolated linearly between the two nearest ranks.

    Null values don't count; NaN is greater than any number. Groups without values have no row; key columns may be null. few: values
    of a group and point that are put in order at the end; more of them are narrowed down again, `rounds` times at most.
    """
    by = [f"_k{i}" for i in range(len(keys))] or ["_one"]
    x = df.select(*([F.col(f"`{c}`").alias(k) for c, k in zip(keys, by)] or [F.lit(1).alias("_one")]), value.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    some = x.where(~F.isnan("_x") & (F.abs("_x") < float("inf")))
    # NaN and infinite values have known ranks at the ends, so only their numbers are needed.
    sketch = F.kll_sketch_agg_double(F.when(~F.isnan("_x") & (F.abs("_x") < float("inf")), F.col("_x")), F.lit(K))
    sizes = x.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("_x") == float("-inf")).alias("_less"), F.count_if(F.isnan("_x")).alias("_nan"), F.count_if(F.col("_x") == float("inf")).alias("_inf"), sketch.alias("_s"), F.min(F.when(~F.isnan("_x") & (F.abs("_x") < float("inf")), F.col("_x"))).alias("_lo"), F.max(F.when(~F.isnan("_x") & (F.abs("_x") < float("inf")), F.col("_x"))).alias("_hi"))
    sizes = cut_lineage(sizes)
    want = sizes.select(*by, "n", "_less", "_nan", "_inf", "_s", "_lo", "_hi", F.inline(F.array(*[F.struct(F.lit(i).alias("_p"), F.lit(float(p)).alias("_at")) for i, p in enumerate(points)])))
    want = want.withColumn("_r", F.col("_at") * (F.col("n") - 1)).withColumns({"_m": F.col("n") - F.col("_less") - F.col("_nan") - F.col("_inf"), "_a": F.floor("_r"), "_b": F.ceil("_r")})
    # Ranks among the finite values; _base: finite values known to lie below the bracket, _in: inside it.
    want = want.withColumns({"_ra": F.col("_a") - F.col("_less"), "_rb": F.col("_b") - F.col("_less"), "_base": F.lit(0).cast("bigint"), "_in": F.col("_m")})
    state = want
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in by]
    most = sizes.agg(F.max("n")).first()[0] or 0
    for _ in range(rounds):
        if most <= few:
            break
        narrow = cut_lineage(_narrowed(state))
        lookup = broadcast_if_small(narrow.groupBy(*by).agg(F.collect_list(F.struct("_p", "_lo", "_hi")).alias("_all")), 100_000)
        met = some.alias("v").join(lookup.alias("w"), same(_sides("v"), _sides("w")))
        cells = met.select(*[F.col(f"v.{k}") for k in by], "_x", F.inline("_all")).where(F.col("_x") <= F.col("_hi"))
        inside = F.col("_x") >= F.col("_lo")
        counts = cells.groupBy(*by, "_p").agg(F.count_if(~inside).alias("_below"), F.count_if(inside).alias("_within"), F.kll_sketch_agg_double(F.when(inside, F.col("_x")), F.lit(K)).alias("_t")).withColumnsRenamed({k: f"{k}_" for k in by} | {"_p": "_p_"})
        got = narrow.join(counts, [narrow[k].eqNullSafe(F.col(f"{k}_")) for k in by] + [F.col("_p") == F.col("_p_")], "left")
        # A bracket that missed its ranks, which is less likely than one in a million, falls back to the one before.
        ok = (F.col("_below") <= F.greatest("_ra", F.lit(0))) & (F.col("_below") + F.col("_within") > F.least("_rb", F.col("_m") - 1))
        pick = lambda new, old: F.when(ok, F.col(new)).otherwise(F.col(old))
        state = got.select(*by, "n", "_less", "_nan", "_inf", "_p", "_r", "_m", "_a", "_b", "_ra", "_rb", pick("_lo", "_lo0").alias("_lo"), pick("_hi", "_hi0").alias("_hi"), pick("_below", "_base").alias("_base"), pick("_within", "_in").alias("_in"), pick("_t", "_s").alias("_s"))
        state = cut_lineage(state)
        most = state.agg(F.max("_in")).first()[0] or 0
    lookup = broadcast_if_small(state.groupBy(*by).agg(F.collect_list(F.struct("_p", "_lo", "_hi", "_base", "_ra", "_rb")).alias("_all")), 100_000)
    met = some.alias("v").join(lookup.alias("w"), same(_sides("v"), _sides("w")))
    left = met.select(*[F.col(f"v.{k}") for k in by], "_x", F.inline("_all")).where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
    ties = left.groupBy(*by, "_p", "_x", "_base", "_ra", "_rb").agg(F.count("*").alias("_c"))
    upto = F.col("_base") + F.sum("_c").over(Window.partitionBy(*by, "_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ties.withColumn("_u", upto)
    at = lambda r: F.max(F.when((F.col(r) < F.col("_u")) & (F.col(r) >= F.col("_u") - F.col("_c")), F.col("_x")))
    found = ranked.groupBy(*by, "_p").agg(at("_ra").alias("_va"), at("_rb").alias("_vb")).withColumnsRenamed({k: f"{k}_" for k in by} | {"_p": "_p_"})
    full = state.join(found, [state[k].eqNullSafe(F.col(f"{k}_")) for k in by] + [F.col("_p") == F.col("_p_")], "left")
    end = lambda v, r: F.when(F.col(r) < 0, float("-inf")).when(F.col(r) >= F.col("_m") + F.col("_inf"), float("nan")).when(F.col(r) >= F.col("_m"), float("inf")).otherwise(F.col(v))
    lo, hi = end("_va", "_ra"), end("_vb", "_rb")
    y = F.when(F.col("_a") == F.col("_b"), lo).otherwise(lo * (F.col("_b") - F.col("_r")) + hi * (F.col("_r") - F.col("_a")))
    out = full.withColumn("_y", y).groupBy(*by, "n").agg(*[F.max(F.when(F.col("_p") == i, F.col("_y"))).alias(name) for i, name in enumerate(names)])
    return out.select(*[F.col(k).alias(c) for k, c in zip(by, keys)], "n", *names)


def _sides(alias: str):
    class Side:
        def __getitem__(self, k: str) -> Column:
            return F.col(f"{alias}.{k}")

    return Side()


def _narrowed(state: DataFrame) -> DataFrame:
    """state with a bracket around both ranks, as the sketch of the values inside the present one gives it; the present one stays in
    _lo0 and _hi0. A bracket that reaches an end of the values is that end."""
    m = F.col("_in").cast("double")
    low, high = (F.col("_ra") - F.col("_base")) / m - REACH, (F.col("_rb") - F.col("_base") + 1) / m + REACH
    usable = (F.col("_in") > 0) & (F.kll_sketch_get_n_double("_s") > 0)
    grid = F.when(usable, F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])))
    at = lambda i: F.try_element_at("_q", F.greatest(F.lit(0), F.least(F.lit(GRID), i)).cast("int") + 1)
    x = state.withColumns({"_lo0": F.col("_lo"), "_hi0": F.col("_hi"), "_q": grid})
    lo, hi = at(F.floor(low * GRID)), at(F.ceil(high * GRID))
    return x.withColumns({"_lo": F.when((low > 0) & lo.isNotNull(), lo).otherwise(F.col("_lo0")), "_hi": F.when((high < 1) & hi.isNotNull(), hi).otherwise(F.col("_hi0"))}).drop("_q")
