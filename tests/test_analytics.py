import json
import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.intervals import bars_of, interval_hours
from barloom.functions.numeric import norm_cdf, norm_ppf
from barloom import session
from barloom.operators import audit, contracts, dataset, features, joins, metrics, quantiles, robustness, simulate, splits, windows
from barloom.plans import reference_queries
from barloom.sources import artifacts, rest
from barloom.streaming.bars import streaming_bars

STEP = 14_400


def walk(n=260, seed=1, instrument="a"):
    r = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(r.normal(0, 0.01, n)))
    o = np.r_[100, c[:-1]]
    return pd.DataFrame({"instrument": instrument, "bar_s": np.arange(n) * STEP, "open": o, "high": np.maximum(o, c) * 1.001, "low": np.minimum(o, c) * 0.999, "close": c, "volume": r.uniform(1, 10, n)})


BAR = "instrument string, bar_s bigint, open double, high double, low double, close double, volume double"


def frame(spark, pdf):
    return spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], BAR)


def test_features_against_pandas(spark):
    p = walk()
    got = features.bar_features(frame(spark, p)).orderBy("bar_s").toPandas()
    r = np.log(p.close / p.close.shift())
    d = p.close.diff()
    up, down = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    want = {"log_ret_1": r, "log_ret_24": np.log(p.close / p.close.shift(6)), "vol_roll": r.rolling(6).std(), "rsi": 100 - 100 / (1 + up / (down + 1e-8)), "vol_z": (p.volume - p.volume.rolling(100).mean()) / (p.volume.rolling(100).std() + 1e-8), "ma_ratio": p.close.rolling(6).mean() / (p.close.rolling(42).mean() + 1e-8), "log_ret_1_fwd": r.shift(-1)}
    for name, w in want.items():
        np.testing.assert_allclose(got[name].astype(float), w, atol=1e-8, err_msg=name)
    assert len(features.usable_rows(features.bar_features(frame(spark, p))).collect()) == 260 - 99 - 1


def test_features_are_causal(spark):
    p = walk()
    whole = {r.bar_s: r for r in features.bar_features(frame(spark, p)).collect()}
    part = features.bar_features(frame(spark, p[:200])).collect()
    for r in part:
        for name in features.FEATURES:
            a, b = r[name], whole[r.bar_s][name]
            assert (a is None and b is None) or abs(a - b) < 1e-12
    assert all(r.log_ret_1_fwd is None for r in part if r.bar_s == 199 * STEP)


def test_constant_price_and_volume(spark):
    p = walk(150)
    p[["open", "high", "low", "close"]], p["volume"] = 5.0, 3.0
    last = features.bar_features(frame(spark, p)).where(F.col("bar_s") == 149 * STEP).first()
    assert last.vol_z == 0.0 and last.rsi == 0.0 and abs(last.ma_ratio - 1) < 1e-8


def test_asof_against_brute_force(spark):
    r = np.random.default_rng(4)
    left = [("ab"[i % 2], int(t), i) for i, t in enumerate(r.integers(0, 1000, 80))] + [("a", None, 900), (None, 5, 901), ("c", 5, 902)]
    right = [("ab"[i % 2], int(t), float(i)) for i, t in enumerate(r.integers(300, 900, 25))]
    right += [(right[0][0], right[0][1], 99.0), ("a", None, 1.0), (None, 1, 1.0)]
    for chunk in (7, 100, 1 << 22):
        out = joins.asof_backward(spark.createDataFrame(left, "k string, t bigint, i int"), spark.createDataFrame(right, "k string, u bigint, v double"), "k", "t", "u", ["v"], chunk)
        got = {x.i: x.v for x in out.collect()}
        for k, t, i in left:
            known = [(u, v) for kk, u, v in right if None not in (k, t, u) and kk == k and u <= t]
            assert got[i] == (max(known)[1] if known else None)
    with pytest.raises(ValueError):
        joins.asof_backward(spark.createDataFrame(left, "k string, t bigint, i int"), spark.createDataFrame(right, "k string, u bigint, v double"), "k", "t", "u", ["v"], strict=True)


def test_exact_join_checks_keys(spark):
    b = frame(spark, walk(5))
    with pytest.raises(ValueError):
        joins.exact_join(b, b.union(b), ["instrument", "bar_s"])
    with pytest.raises(ValueError):
        joins.merge_regime(b, b.where("bar_s <> 14400").select("instrument", "bar_s", F.lit(0.5).alias("p_filter_0")))


def test_regime_merge_checks_keys_without_strict(spark):
    b = frame(spark, walk(5))
    pack = b.select("instrument", "bar_s", F.lit(0.5).alias("p_filter_0"))
    with pytest.raises(ValueError):
        joins.merge_regime(b, pack.union(pack), strict=False)
    assert joins.merge_regime(b, pack.where("bar_s <> 14400"), strict=False).count() == 4


def test_splits(spark):
    x = splits.chronological(frame(spark, walk(101)))
    n = {r.split: r["count"] for r in x.groupBy("split").count().collect()}
    assert n == {"train": 79, "val": 9, "test": 11}
    for f in splits.fold_table(2400):
        assert f["start_rn"] < f["end_rn"] <= 2400
    rows = splits.fold_table(2400)
    for k in {f["fold"] for f in rows}:
        a, b, c = sorted((f for f in rows if f["fold"] == k), key=lambda f: f["start_rn"])
        assert a["end_rn"] < b["start_rn"] and b["end_rn"] + 24 <= c["start_rn"]
    assert splits.fold_table(100) == [] and splits.walk_forward(frame(spark, walk(20)), 20).count() == 0
    with pytest.raises(ValueError):
        splits.explicit(frame(spark, walk(20)), {"train": (5, 5)})

def test_folds_over_each_series_own_length(spark):
    sizes = {"long": 2405, "middle": 601, "odd": 255, "short": 150}
    df = frame(spark, pd.concat([walk(n, instrument=k) for k, n in sizes.items()]))
    want = {(k, f["fold"], f["split"], f["start_rn"], f["end_rn"]) for k, n in sizes.items() for f in splits.fold_table(n)}
    assert {tuple(r) for r in splits.fold_manifest(df).collect()} == want and {w[0] for w in want} == {"long", "middle", "odd"}
    got = splits.walk_forward(df).groupBy("instrument", "fold", "split").agg(F.min("rn"), F.max("rn") + 1, F.count("*")).collect()
    assert {tuple(r)[:5] for r in got} == want and all(r[5] == r[4] - r[3] for r in got)
    many = spark.range(1, 6000).withColumn("f", F.explode(splits.fold_ranges(F.col("id")))).select("id", "f.*").collect()
    assert {tuple(r) for r in many} == {(n, *f.values()) for n in range(1, 6000) for f in splits.fold_table(n)}

def test_fold_queries_on_skewed_lengths(spark, tmp_path):
    days = {"long": 600, "short": 150}
    rows = [(k, datetime(2020, 1, 1) + timedelta(days=i), 100.0 + i % 7, i) for k, n in days.items() for i in range(n)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate timestamp, o_totalprice double, o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    got = reference_queries.QUERIES["ref_k2_k3_walk_forward"](spark, str(tmp_path)).collect()
    assert {r.instrument for r in got} == {"long"} and len(got) == 9
    assert max(r.last_s for r in got) == datetime(2020, 1, 1, tzinfo=timezone.utc).timestamp() + 527 * 86_400  # 120 + 336 + 24 + 48 - 1
    assert reference_queries.QUERIES["ref_k4_fold_manifest"](spark, str(tmp_path)).count() == 9
    assert reference_queries.QUERIES["ref_r12_fold_policy"](spark, str(tmp_path)).count() == 9


def test_ledger_identities(spark):
    p = walk(120)
    t = simulate.ledger(simulate.actions(frame(spark, p), ("long", "short", "flat")), simulate.SimRules(0.0, 0.0)).toPandas()
    by = {k: g.sort_values("bar_s") for k, g in t.groupby("policy")}
    assert len(by["long"]) == 119 and (by["flat"].equity == 1).all()
    np.testing.assert_allclose(by["long"].equity, p.close[1:].to_numpy() / p.close[0], rtol=1e-12)
    np.testing.assert_allclose(by["long"].equity.to_numpy() * by["short"].equity.to_numpy(), 1.0, rtol=1e-12)


def test_ruin_cuts_the_path(spark):
    p = walk(40)
    p.loc[20:, "close"] = p.close[19] * 0.01
    t = simulate.ledger(simulate.actions(frame(spark, p), ("long",))).toPandas()
    assert len(t) == 20 and t.equity.min() < 0.15


def test_rollout_equals_the_window_ledger(spark):
    b = frame(spark, walk(60))
    a = simulate.rollout(b, lambda o: 1.0, ("close",)).orderBy("bar_s").toPandas()
    w = simulate.ledger(simulate.actions(b, ("long",))).orderBy("bar_s").toPandas()
    np.testing.assert_allclose(a.equity, w.equity, rtol=1e-12)


def test_metrics_of_small_and_flat_curves(spark):
    one = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.1), ("b", 0, 1.0), ("b", 1, 1.0), ("b", 2, 1.0), ("b", 3, 1.0)], "k string, bar_s bigint, equity double")
    m = {r.k: r for r in metrics.equity_metrics(one, ("k",), 365.0).collect()}
    assert m["a"].sharpe == 0.0 and m["a"].cum_return == 0.0 and m["b"].sharpe == 0.0 and m["b"].max_dd == 0.0
    assert metrics.drawdown_events(one.where("k = 'b'"), ("k",)).count() == 0
    assert metrics.equity_metrics(one.limit(0), ("k",), 365.0).count() == 0


def test_trades_by_hand(spark):
    pos = [0.0, 1.0, 1.0, -1.0, -1.0, 0.0, 1.0]
    eq = [1.0, 1.1, 1.2, 1.0, 1.3, 1.25, 1.2]
    t = spark.createDataFrame([("a", i, p, e, 0.0) for i, (p, e) in enumerate(zip(pos, eq))], "k string, bar_s bigint, pos double, equity double, pos_prev double")
    got = [(r.side, r.entry_i, r.exit_i, r.duration_bars, round(r.pnl, 9), round(r.mfe, 9)) for r in metrics.trades(t, ("k",)).orderBy("entry_i").collect()]
    assert got == [("long", 1, 3, 3, -0.1, round(1.2 / 1.1 - 1, 9)), ("short", 3, 5, 3, 0.25, 0.3)]


def test_bootstrap_rows(spark):
    x = robustness.block_bootstrap(spark.createDataFrame([("a", 50)], "k string, n bigint"), "k", 20, 7).toPandas()
    assert len(x) == 1000 and x.rn.between(0, 49).all() and (x.groupby("boot").step.nunique() == 50).all()
    flat = robustness.block_bootstrap(spark.createDataFrame([("a", 50)], "k string, n bigint"), "k", 20, 7, circular=False).toPandas()
    starts = flat[flat.step % 7 == 0].rn
    assert (starts <= 43).all()

def test_reality_check_of_2000_draws(spark, data):
    p = reference_queries.QUERIES["ref_r9_reality_check_2000x48"](spark, data).first().p_value
    assert 0 < p <= 1 and abs(p * 2001 - round(p * 2001)) < 2e-3


def test_scalars():
    assert abs(norm_cdf(1.96) - 0.975) < 1e-4 and abs(norm_ppf(0.975) - 1.959964) < 1e-5
    d = robustness.deflated_sharpe(0.1, 30, 1000)
    assert 0 < d["p_value"] < 1 and abs(d["sr_star"] - math.sqrt(2 * math.log(30)) / math.sqrt(999)) < 1e-12
    assert [interval_hours(t) for t in ("4h", "15m", "1D", "30min", "h")] == [4.0, 0.25, 24.0, 0.5, 1.0] and interval_hours("?", 1.0) == 1.0
    assert bars_of(24, 4) == 6 and bars_of(10, 4) == 2 and bars_of(1, 4, 2) == 2
    with pytest.raises(ValueError):
        interval_hours("soon")
    assert robustness.effective_trials("seed_fold", 2, 5, 6) == 60


def test_contracts():
    c = contracts.ObservationContract("market_plus_regime", ("rsi",), ("p_filter_0",))
    assert c.columns() == ["rsi", "p_filter_0", *contracts.STATE]
    for bad in (contracts.ObservationContract("all", (), ()), contracts.ObservationContract("market_only", ("log_ret_1_fwd",), ()), contracts.ObservationContract("market_only", ("rsi", "rsi"), ())):
        with pytest.raises(ValueError):
            bad.columns()
    assert contracts.forward_column(["b_fwd", "a_fwd"]) == "a_fwd" and contracts.forward_column(["x"]) is None
    assert features.forbidden_names(["rsi", "y_1", "my_label", "next_open"]) == ["y_1", "my_label", "next_open"]


def test_artifacts(spark, tmp_path):
    path = str(tmp_path / "runs.csv")
    artifacts.append_run(spark, path, {"run_id": "r1", "score_val": 0.1234567890123, "unknown": 5, "sharpe_oos": float("nan")})
    artifacts.append_run(spark, path, {"run_id": "r2"})
    got = {r.run_id: r for r in spark.read.schema(artifacts.REGISTRY).option("header", True).csv(path).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].score_val == "0.123456789" and not got["r1"].sharpe_oos
    (tmp_path / "m.json").write_text(json.dumps({"oos": {"sharpe": "1.5", "dd": None}}))
    assert artifacts.flat_metrics(artifacts.read_table(spark, str(tmp_path / "m.json")), {"s": "oos.sharpe", "d": "oos.dd", "x": "oos.none"}).first().asDict() == {"s": 1.5, "d": 0.0, "x": 0.0}
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "a.json").write_text("{}")
    assert artifacts.latest_dataset(str(tmp_path), ("a.json",)).name == "run1" and len(artifacts.sha256(str(tmp_path / "m.json"))) == 64
    with pytest.raises(FileNotFoundError):
        artifacts.latest_dataset(str(tmp_path), ("b.json",))
    with pytest.raises(ValueError):
        artifacts.read_table(spark, "x.orc")


def test_pagination():
    rows = list(range(0, 2500, 10))
    fetch = lambda a, b, n: [x for x in rows if a <= x <= b][:n]
    assert list(rest.paginate(fetch, 0, 2000, lambda x: x, 7)) == [x for x in rows if x <= 2000]
    assert list(rest.paginate(lambda a, b, n: [5] * n, 0, 9, lambda x: x, 2, 50))[:2] == [5, 5]


def test_streaming_bars_equal_batch_bars(spark, data, tmp_path):
    from barloom.sources.bars import panel_bars

    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    b = streaming_bars(stream, F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"), late="3650 days")
    q = b.writeStream.outputMode("complete").format("memory").queryName("bars_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("bars_out").collect()}
    assert got == {tuple(r) for r in panel_bars(spark, data).select("instrument", "bar_s", "open", "high", "low", "close", "volume").collect()}


@pytest.mark.parametrize("alpha", [0.0005, 0.01, 0.25, 0.9, 0.9999999, 1.0])
def test_ewma_is_exact(spark, alpha):
    r = np.random.default_rng(5)
    x = [None if r.random() < 0.1 else float(v) for v in r.normal(0, 1, 2500)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", 0, None), ("b", 1, 2.0)], "instrument string, bar_s bigint, x double")
    for start in (None, 0.5):
        got = {(g.instrument, g.bar_s): g.y for g in windows.with_ewma(df, {"y": F.col("x")}, alpha, "instrument", start=start).collect()}
        y = start
        for i, v in enumerate(x):
            y = y if v is None else v if y is None else y * (1 - alpha) + v * alpha
            assert (y is None and got["a", i] is None) or abs(got["a", i] - y) < 1e-9
        assert got["b", 0] == start
    ones = spark.createDataFrame([("a", i, 1.0) for i in range(2000)], "instrument string, bar_s bigint, x double")
    assert windows.with_ewma(ones, {"y": F.col("x")}, alpha, "instrument").where("abs(y - 1) > 1e-12").count() == 0
    with pytest.raises(ValueError):
        windows.with_ewma(ones, {"y": F.col("x")}, 0.0, "instrument")


def test_stress_windows_against_brute_force(spark):
    e = np.exp(np.cumsum(np.random.default_rng(8).normal(0, 0.02, 200)))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(e)] + [("short", i, 1.0) for i in range(20)], "instrument string, bar_s bigint, equity double")
    for window in (17, 50):
        want = []
        for i in range(200 - window):
            seg = e[i : i + window]
            want.append((seg[-1] / seg[0] - 1, float((1 - seg / np.maximum.accumulate(seg)).max())))
        for r in robustness.stress_windows(df, "instrument", window, 500).collect():
            assert r.instrument == "a" and abs(r.cum_return - want[r.rn][0]) < 1e-12 and abs(r.max_dd - want[r.rn][1]) < 1e-12
        assert robustness.stress_windows(df, "instrument", window, 500).count() == 2 * (200 - window)


def test_exact_percentiles(spark):
    r = np.random.default_rng(2)
    per = {"many": r.normal(0, 1, 30_000), "ties": r.integers(0, 3, 5000).astype(float), "one": np.array([4.0]), None: r.exponential(1, 900), "odd": np.array([float("inf"), float("-inf"), 1.0, 2.0, float("nan"), 3.0])}
    rows = [(k, float(v)) for k, x in per.items() for v in x] + [("none", None), ("many", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = (0.0, 0.01, 0.25, 0.5, 0.999, 1.0)
    names = [f"q{i}" for i in range(len(points))]
    want = {x.k: x for x in df.where("v is not null").groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for p, n in zip(points, names)]).collect()}
    for few in (100_000, 50):
        got = {x.k: x for x in quantiles.exact_percentiles(df, ["k"], F.col("v"), points, names, few=few).collect()}
        assert set(got) == set(per) == set(want) and got["many"].n == 30_000
        for k in per:
            for n in names:
                a, b = got[k][n], want[k][n]
                assert abs(a - b) < 1e-12 or (k == "odd" and (a == b or a != a)), (few, k, n, a, b)
    assert abs(quantiles.exact_percentiles(df.where("k = 'ties'"), [], F.col("v"), (0.5,), ("m",)).first().m - 1.0) < 1e-12
    assert quantiles.exact_percentiles(df.limit(0), ["k"], F.col("v"), (0.5,), ("m",)).count() == 0


def test_pack_report_by_chunks(spark):
    r = np.random.default_rng(3)
    rows = [("ab"[i % 2], int(t)) for i, t in enumerate(r.integers(0, 3000, 300))] + [("a", None), (None, 5), (None, 5), ("lone", 7)]
    df = spark.createDataFrame(rows, "k string, us bigint")
    for chunk in (100, 10**9):
        for x in audit.pack_report(df, "k", "us", chunk).collect():
            t = sorted(u for k, u in rows if k == x.k and u is not None)
            g = np.diff(t)
            assert (x.n_rows, x.n_distinct, x.n_repeated) == (len(t), len(set(t)), len(t) - len(set(t)))
            assert (x.min_gap, x.max_gap, x.median_gap) == ((g.min(), g.max(), float(np.median(g))) if len(g) else (None, None, None))


def test_single_reality_check(spark):
    up = [("up", i, 0.01 + 0.001 * (i % 5)) for i in range(60)] + [("down", i, -0.01) for i in range(60)] + [("few", i, 1.0) for i in range(9)]
    got = {r.k: r for r in robustness.single_reality_check(spark.createDataFrame(up, "k string, rn int, r double"), "k", 50, 20).collect()}
    assert got["up"].p_value == 0.0 and got["down"].p_value == 1.0 and got["few"].p_value is None and got["few"].n == 9


def test_tails_and_trials(spark):
    z = [-3.0, -0.5, 0.0, 0.7, 2.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(robustness.upper_tail(F.col("z"))).collect()]
    assert max(abs(g - (1 - norm_cdf(v))) for g, v in zip(got, z)) < 1e-6
    assert robustness.deflated_sharpe(0.1, 1, 2)["sr_star"] == 0.0


def test_forbidden_parts_anywhere():
    assert features.forbidden_names(["x_next_bar", "ray_y_1", "my_close", "close"]) == ["x_next_bar", "ray_y_1", "my_close"]


def test_wide_dataset_refuses_bad_blocks(spark):
    b = frame(spark, walk(80))
    funding = spark.createDataFrame([("a", 0, 0.0001)], "instrument string, funding_s bigint, rate double")
    block = b.select("bar_s", F.lit(1.0).alias("hc_growth_cycle"))
    out = dataset.wide_dataset(b, funding, {"macro": (block.union(block), ["hc_growth_cycle"])})
    assert out.count() == 80 - 19 and out.columns[-1] == "hc_growth_cycle"
    with pytest.raises(ValueError, match="repeats"):
        dataset.wide_dataset(b, funding, {"a": (block, ["hc_growth_cycle"]), "b": (block, ["hc_growth_cycle"])})
    with pytest.raises(ValueError, match="missing"):
        dataset.wide_dataset(b, funding, {"a": (block, ["nothing"])})
    with pytest.raises(ValueError, match="no funding rate"):
        dataset.wide_dataset(b, funding.drop("rate"), {})


def test_json_manifest_and_regime_pack(spark, tmp_path):
    place = str(tmp_path / "m.json")
    artifacts.write_json(place, {"a": {3, 1}, "p": tmp_path, "x": np.float64("nan"), "n": np.arange(2), "t": datetime(2024, 1, 1)})
    artifacts.write_json(place, {"b": 1}, merge=True, spark=spark)
    assert artifacts.read_json(place, spark) == {"a": [1, 3], "p": str(tmp_path), "x": None, "n": [0, 1], "t": "2024-01-01T00:00:00", "b": 1}
    m = artifacts.run_manifest(spark, {"x": spark.range(3)}, {"seed": 1})
    assert m["inputs"]["x"]["n_rows"] == 3 and m["settings"] == {"seed": 1}
    folder = tmp_path / "pack"
    folder.mkdir()
    pd.DataFrame({"timestamp": ["2024-01-01 00:00:00", "2024-01-01 00:00:00", "soon"], "segment": "s", "p_filter_0": [0.2, 0.1, 0.3]}).to_parquet(folder / "rl_observation_pack.parquet")
    contract = {"agent_observable_columns_v1": ["p_filter_0"], "forbidden_columns_v1": []}
    artifacts.write_json(str(folder / "feature_contract.json"), contract)
    artifacts.write_json(str(folder / "manifest.json"), {"sha256": artifacts.sha256(str(folder / "rl_observation_pack.parquet"))})
    p = artifacts.read_regime_pack(spark, str(folder), strict=False)
    assert [(r.segment, r.p_filter_0) for r in p.rows.collect()] == [("s", 0.1)] and p.quality is None and p.digest == p.manifest["sha256"]
    with pytest.raises(ValueError, match="1 rows without a time, 1 repeated"):
        artifacts.read_regime_pack(spark, str(folder))
    artifacts.write_json(str(folder / "manifest.json"), {"sha256": "0"})
    with pytest.raises(ValueError, match="manifest"):
        artifacts.read_regime_pack(spark, str(folder), strict=False)
    artifacts.write_json(str(folder / "feature_contract.json"), {**contract, "forbidden_columns_v1": ["segment"]})
    with pytest.raises(ValueError, match="forbidden"):
        artifacts.read_regime_pack(spark, str(folder), strict=False)


def test_default_path(tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        artifacts.default_path(str(tmp_path))
    (tmp_path / "ohlcv.csv").write_text("x")
    assert artifacts.default_path(str(tmp_path)).endswith("ohlcv.csv")
    monkeypatch.setenv("BARLOOM_DATA", "/d/x.parquet")
    assert artifacts.default_path(str(tmp_path)) == "/d/x.parquet"


def _fetch(start, end, limit):
    return [(t, t * 2) for t in range(-(-start // 10) * 10, end + 1, 10)][:limit]


def test_pages_as_a_table(spark):
    schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("v", T.LongType())])
    got = rest.read_pages(spark, _fetch, schema, 5, 2005, lambda row: row[0], span_ms=300, limit=7)
    assert sorted(map(tuple, got.collect())) == [(t, t * 2) for t in range(10, 2001, 10)] and got.rdd.getNumPartitions() == 7


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    fake = type("S", (), {"conf": Conf(), "sparkContext": type("C", (), {"getConf": lambda self: Conf(), "master": "spark://host:7077"})()})()
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(fake)


def test_command_line(spark, data, tmp_path, capsys):
    from barloom.__main__ import main

    trace = simulate.ledger(simulate.actions(frame(spark, walk(120)), ("long", "random")))
    artifacts.write_table(trace, str(tmp_path / "trace.parquet"))
    main(["eval", str(tmp_path / "trace.parquet"), str(tmp_path / "eval")], spark)
    main(["robustness", str(tmp_path / "trace.parquet"), str(tmp_path / "rob"), "--draws", "20", "--block", "10", "--window", "30"], spark)
    assert spark.read.parquet(str(tmp_path / "eval" / "metrics.parquet")).count() == 2 and spark.read.parquet(str(tmp_path / "rob" / "stress.parquet")).count() == 20
    artifacts.write_table(frame(spark, walk(80)), str(tmp_path / "market.parquet"))
    artifacts.write_table(spark.createDataFrame([("a", 0, 0.0001)], "instrument string, funding_s bigint, rate double"), str(tmp_path / "f.csv"))
    main(["build", str(tmp_path / "wide.parquet"), "--market", str(tmp_path / "market.parquet"), "--funding", str(tmp_path / "f.csv")], spark)
    assert spark.read.parquet(str(tmp_path / "wide.parquet")).count() == 61 and artifacts.read_json(str(tmp_path / "wide.manifest.json"))["inputs"]["market"]["n_rows"] == 80
    main(["list"])
    assert "ref_j7_wide_dataset" in capsys.readouterr().out
