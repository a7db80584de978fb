"""Chronological splits and walk-forward folds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, *keys: str, order: str = "bar_s") -> DataFrame:
    """df with rn, the row's number from 0, and n, the number of rows, of each series of bars."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"rn": F.row_number().over(w.orderBy(order)) - 1, "n": F.count("*").over(w)})


def chronological(df: DataFrame, train: float = 0.8, val: float = 0.1, drop_last: bool = True, key: str = "instrument") -> DataFrame:
    """df with rn and split; the last row of train and of val, whose forward return lies in the next split, is dropped."""
    x = numbered(df, key)
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * train) + F.floor(F.col("n") * val)
    x = x.withColumn("split", F.when(F.col("rn") < a, "train").when(F.col("rn") < b, "val").otherwise("test"))
    if drop_last:
        x = x.where((F.col("rn") != a - 1) & (F.col("rn") != b - 1))
    return x.drop("n")


def explicit(df: DataFrame, spec: dict[str, tuple[int, int | None]], key: str = "instrument") -> DataFrame:
    """Rows of half-open ranges of row numbers, labelled; an end of None is that of the series. Raises on a range that isn't one."""
    for name, (a, b) in spec.items():
        if not 0 <= a or (b is not None and a >= b):
            raise ValueError(f"bad range of {name}: {a}, {b}")
    label = F.coalesce(*[F.when((F.col("rn") >= a) & (F.lit(True) if b is None else F.col("rn") < b), F.lit(name)) for name, (a, b) in spec.items()])
    return numbered(df, key).withColumn("split", label).where(F.col("split").isNotNull()).drop("n")


@dataclass(frozen=True)
class FoldRules:
    train: float = 0.6
    val: float = 0.1
    test: float = 0.1
    step: float = 0.1
    folds: int = 6
    purge: int = 1
    embargo: int = 24
    least_span: int = 200
    least: tuple[int, int, int] = (50, 20, 20)


def fold_table(n: int, rules: FoldRules = FoldRules()) -> list[dict[str, int]]:
    """Ranges of row numbers of each fold over n rows; roundings are half to even."""
    span = max(rules.least_span, round((rules.train + rules.val + rules.test) * n))
    step, out = max(1, round(rules.step * n)), []
    for k in range(rules.folds):
        start = k * step
        if start + span > n:
            break
        a, b, c = round(rules.train * span), round((rules.train + rules.val) * span), round(rules.test * span)
        cut = {"train": (0, a - rules.purge), "val": (a, b - rules.purge), "test": (b + rules.embargo, min(span, b + rules.embargo + c))}
        if all(hi - lo >= least for (lo, hi), least in zip(cut.values(), rules.least)):
            out += [{"fold": k, "split": s, "start_rn": start + lo, "end_rn": start + hi} for s, (lo, hi) in cut.items()]
    return out


def fold_ranges(n: Column, rules: FoldRules = FoldRules()) -> Column:
    """fold_table of each value of n, an array of (fold, split, start_rn, end_rn); rint rounds half to even, as Python does."""
    n = n.cast("double")
    span, step = F.greatest(F.lit(float(rules.least_span)), F.rint((rules.train + rules.val + rules.test) * n)), F.greatest(F.lit(1.0), F.rint(rules.step * n))
    a, b, c = F.rint(rules.train * span), F.rint((rules.train + rules.val) * span), F.rint(rules.test * span)
    cut = {"train": (F.lit(0.0), a - rules.purge), "val": (a, b - rules.purge), "test": (b + rules.embargo, F.least(span, b + rules.embargo + c))}
    long_enough = reduce(lambda x, y: x & y, [hi - lo >= least for (lo, hi), least in zip(cut.values(), rules.least)])
    row = lambda k, s, lo, hi: F.struct(F.lit(k).alias("fold"), F.lit(s).alias("split"), (k * step + lo).cast("int").alias("start_rn"), (k * step + hi).cast("int").alias("end_rn"))
    rows = [F.when(long_enough & (k * step + span <= n), row(k, s, lo, hi)) for k in range(rules.folds) for s, (lo, hi) in cut.items()]
    return F.filter(F.array(*rows), lambda f: f.isNotNull())


def walk_forward(df: DataFrame, n: int | None = None, rules: FoldRules = FoldRules(), key: str = "instrument") -> DataFrame:
    """The rows of each fold and split: each row is written to the folds that hold it. Folds are cut over each series' own number of
    rows, or over n rows where it is given; a series too short for a fold has none, whatever the others have."""
    x = numbered(df, key).withColumn("_folds", fold_ranges(F.col("n") if n is None else F.lit(n), rules))
    hits = F.filter("_folds", lambda f: (F.col("rn") >= f["start_rn"]) & (F.col("rn") < f["end_rn"]))
    return x.withColumn("_hit", F.explode(hits)).withColumns({"fold": F.col("_hit.fold"), "split": F.col("_hit.split")}).drop("_hit", "_folds")


def fold_manifest(df: DataFrame, rules: FoldRules = FoldRules(), key: str = "instrument") -> DataFrame:
    """(key, fold, split, start_rn, end_rn) of each series of df."""
    return df.groupBy(key).agg(F.count("*").alias("n")).select(key, F.explode(fold_ranges(F.col("n"), rules)).alias("_f")).select(key, "_f.*")


def frozen_scaling(df: DataFrame, features: list[str], key: str = "instrument", limit: float = 10.0) -> DataFrame:
    """Features scaled by the mean and standard deviation of the key's train rows, clipped to +-limit."""
    w = Window.partitionBy(key)
    own = lambda c: F.when(F.col("split") == "train", F.col(c))
    z = lambda c: (F.col(c) - F.avg(own(c)).over(w)) / (F.stddev_pop(own(c)).over(w) + 1e-8)
    return df.withColumns({c: F.greatest(F.lit(-limit), F.least(F.lit(limit), z(c))) for c in features})
