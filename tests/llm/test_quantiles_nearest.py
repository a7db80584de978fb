from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import nearest, quantiles

METRICS = ("x", "y")


def runs(spark, rows):
    return spark.createDataFrame(rows, "run_id bigint, row_id bigint, g string, fold int, day date, x double, y double, n int, metric string")


def table(spark, rows, k=2048):
    df = quantiles.once_per_run(runs(spark, rows), "run_id", "row_id", ["g", "fold", "day", "x", "y"])
    days = quantiles.day_states(df, F.col("day"), ["g", "fold"], METRICS, k)
    return days, quantiles.merge_states(days, ["g", "fold"], METRICS)


def test_small_groups_are_exact_and_runs_count_once(spark):
    day = datetime(2024, 1, 1).date()
    rows = [(i, i, "a", 0, day + timedelta(days=i % 5), float(i), None, 1, "m") for i in range(1, 102)]
    rows += [(5, 500, "a", 0, day, 1e9, 1.0, 1, "m"), (None, 501, "b", None, day, float("nan"), float("inf"), 1, "m"), (None, 502, "b", None, day, 3.0, -3.0, 1, "m"), (900, 503, "c", 1, None, None, None, 1, "m")]
    days, groups = table(spark, rows)
    assert days.count() == 7
    got = {(r.g, r.metric): r for r in quantiles.percentiles(groups, ["g", "fold"], METRICS).collect()}
    a = got["a", "x"]
    assert (a.n, a.p50, a.p01, a.p99, a.rank_error) == (101, 51.0, 2.0, 100.0, 0.0)
    assert got["a", "y"].n == 0 and got["a", "y"].p50 is None
    assert got["b", "x"].n == 1 and got["b", "x"].p50 == 3.0 and got["c", "x"].n == 0


@pytest.mark.parametrize("kind", ["skewed", "ties", "peaks"])
def test_rank_error_over_many_days(spark, kind):
    rng = np.random.default_rng(3)
    n, k = 60_000, 256
    x = {"skewed": rng.lognormal(0, 2, n), "ties": rng.integers(0, 7, n).astype(float), "peaks": np.where(rng.random(n) < 0.5, rng.normal(-5, 0.1, n), rng.normal(5, 2, n))}[kind]
    df = spark.createDataFrame([(int(i % 40), float(v)) for i, v in enumerate(x)], "d int, x double")
    days = quantiles.day_states(df, F.col("d"), [], ["x"], k)
    out = quantiles.percentiles(quantiles.merge_states(days, [], ["x"]), [], ["x"], k).first()
    s = np.sort(x)
    assert out.n == n
    for p in quantiles.POINTS:
        v = out[f"p{round(p * 100):02d}"]
        low, high = np.searchsorted(s, v, "left") / n, np.searchsorted(s, v, "right") / n
        assert low - 2 * out.rank_error <= p <= high + 2 * out.rank_error


def test_empty_table(spark):
    days, groups = table(spark, [])
    assert quantiles.percentiles(groups, ["g", "fold"], METRICS).count() == 0
    total = quantiles.percentiles(quantiles.merge_states(groups, [], METRICS), [], METRICS).collect()
    assert [r.n for r in total] == [0, 0]


T0 = datetime(2024, 1, 1)
LEFT = "lid bigint, e string, f string, timestamp timestamp, _us int, rate double"
RIGHT = "rid bigint, e string, f string, timestamp timestamp, rate double, lid int"


def brute(left, right, tol):
    out = {}
    for lid, e, f, t, *_ in left:
        best = [(abs((t - u).total_seconds()), rid) for rid, e2, f2, u, r, _ in right if None not in (e, f, t, u, r) and (e, f) == (e2, f2) and abs((t - u).total_seconds()) <= tol]
        if best:
            out[lid] = min(best)[1]
    return out


@pytest.mark.parametrize("dense", [2, 256])
def test_nearest_against_brute_force(spark, dense):
    rng = np.random.default_rng(11)
    at = lambda: T0 + timedelta(seconds=int(rng.integers(0, 30_000)))
    left = [(i, "ab"[i % 2], "x", at() if i % 17 else None, 1, 0.0) for i in range(150)] + [(900, None, "x", T0, 1, 0.0), (901, "a", "z", T0, 1, 0.0)]
    right = [(1000 - i, "ab"[i % 2], "x", at() if i % 13 else None, None if i % 11 == 0 else float(i), 5) for i in range(120)]
    right += [(2000 + i, "a", "x", T0 + timedelta(seconds=5000), 1.0, 5) for i in range(40)]  # one time, many ids
    right += [(3000 + i, "a", "x", T0 + timedelta(seconds=6000 + i % 9), float(i), 5) for i in range(40)]
    left += [(500 + i, "a", "x", T0 + timedelta(seconds=5990 + i), 1, 0.0) for i in range(30)]
    for tol, tick in ((600, 300), (45, 300), (600, 60)):
        got = nearest.nearest_by_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["e", "f"], "lid", "rid", values=["rate"], tolerance_s=tol, tick_s=tick, dense=dense)
        rows = got.collect()
        assert {r.lid: r.rid for r in rows} == brute(left, right, tol) and len(rows) == len({r.lid for r in rows})


def test_nearest_ends_included_and_empty(spark):
    left = [(1, "a", "x", T0, 1, 0.0)]
    right = [(7, "a", "x", T0 + timedelta(seconds=60), 1.0, 1), (6, "a", "x", T0 - timedelta(seconds=60), 2.0, 1)]
    run = lambda lhs, rhs, tol: nearest.nearest_by_time(spark.createDataFrame(lhs, LEFT), spark.createDataFrame(rhs, RIGHT), ["e", "f"], "lid", "rid", values=["rate"], tolerance_s=tol).collect()
    assert [(r.rid, r.rate, r.distance_us) for r in run(left, right, 60)] == [(6, 2.0, 60_000_000)]
    assert run(left, right, 59.999999) == [] and run([], right, 60) == [] and run(left, [], 60) == []


@pytest.mark.parametrize("dense", [1, 256])
def test_every_left_record_with_its_columns(spark, dense):
    left = [(1, "a", "x", T0, 1, 0.5), (2, "a", "x", T0 + timedelta(hours=9), 2, 0.25), (3, None, "x", T0, 3, None), (4, "a", "x", None, 4, 1.0)]
    right = [(7, "a", "x", T0 + timedelta(seconds=60 + i), 9.0, 1) for i in range(5)]
    got = nearest.nearest_by_time(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["e", "f"], "lid", "rid", tolerance_s=60, dense=dense, keep=["_us", "rate"])
    assert got.columns == ["lid", "_us", "rate", "rid", "distance_us"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0.5, 7, 60_000_000), (2, 2, 0.25, None, None), (3, 3, None, None, None), (4, 4, 1.0, None, None)]
