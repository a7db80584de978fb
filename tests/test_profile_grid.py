from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from barloom.operators import gridding
from barloom.operators.gridding import grid_series
from barloom.operators.profile import Check, column_states, compare_loads, control_limits, findings, merge_states, refresh_states

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
CHECKS = {"x": Check(0.0, 1.0), "h": Check(pattern="[0-9a-f]{4}")}


def loads(spark, per_load):
    rows = [("p", i, x, h, 7) for i, values in enumerate(per_load) for x, h in values]
    return spark.createDataFrame(rows, "pack string, load int, x double, h string, n int")


def found(spark, per_load):
    s = column_states(loads(spark, per_load), ["pack", "load"], CHECKS, ["x", "h"])
    return {tuple(r) for r in findings(compare_loads(s, "pack", "load"), "load", CHECKS).collect()}


def usual(k):
    return [((i * 0.618 + k * 0.1) % 1.0, f"{i * 37 % 65536:04x}") for i in range(300)]


def test_findings(spark):
    per = [usual(k) for k in range(6)]
    per[1] = [(None if i < 60 else x, h) for i, (x, h) in enumerate(per[1])]
    per[2] = [(0.25 * x, h) for x, h in per[2]]
    per[3] = [(round(x * 50) / 50, h) for x, h in per[3]]
    per[4] = [*per[4][:-2], (2.0, "0f0f"), (0.5, "0F0F")]
    assert found(spark, per) == {(1, "x", "nulls"), (2, "x", "shift"), (3, "x", "distinct"), (4, "x", "range"), (4, "h", "pattern")}


def test_lone_load_empty_table_and_nan(spark):
    assert found(spark, [[(0.5, None), (float("nan"), "0000\n"), (None, "zzzz")]]) == {(0, "x", "range"), (0, "h", "pattern")}
    assert found(spark, []) == set()


def test_states_merge(spark):
    df = loads(spark, [usual(k) for k in range(4)])
    parts = column_states(df, ["pack", "load"], CHECKS)
    whole = {r.column_name: r for r in column_states(df.drop("load"), ["pack"], CHECKS).collect()}
    for r in merge_states(parts, ["pack"]).withColumn("d", F.hll_sketch_estimate("distinct_state")).collect():
        w = whole[r.column_name]
        assert (r.n_rows, r.n_null, r.n_out, r.n_bad, r.low, r.high) == (w.n_rows, w.n_null, w.n_out, w.n_bad, w.low, w.high)
    assert {r.column_name for r in parts.collect()} == {"x", "h", "n"}


def test_merged_extremes_of_every_kind(spark):
    rows = [(0, "10", 10, 10.0, True), (1, "9", 9, 9.5, False), (1, "abc", -2, float("nan"), None), (1, None, 9007199254740993, None, None), (0, "b", 9007199254740992, float("inf"), None)]
    df = spark.createDataFrame(rows, "part int, t string, i bigint, d double, b boolean").withColumns({"at": F.timestamp_seconds(F.col("i") % 1000), "dec": F.col("i").cast("decimal(20,2)")})
    whole = {r.column_name: (r.low, r.high) for r in column_states(df.drop("part"), [], {}).collect()}
    merged = {r.column_name: (r.low, r.high) for r in merge_states(column_states(df, ["part"], {}), []).collect()}
    assert merged == whole and whole["t"] == ("10", "b") and whole["i"] == ("-2", "9007199254740993")


def test_refresh_reads_new_parts_alone(spark, tmp_path):
    df = loads(spark, [usual(k) for k in range(5)])
    df.write.partitionBy("load").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    first = refresh_states(df.where("load < 4"), None, "load", ["pack"], CHECKS, ["x", "h"])
    kept = spark.createDataFrame(first.collect(), first.schema)
    again = refresh_states(df, kept, "load", ["pack"], CHECKS, ["x", "h"])
    whole = {(r.load, r.column_name): r for r in column_states(df, ["load", "pack"], CHECKS, ["x", "h"]).collect()}
    assert {(r.load, r.column_name): r for r in again.select(*first.columns).collect()} == whole and len(whole) == 10
    assert "PartitionFilters: [isnotnull(load" in again._jdf.queryExecution().toString() and "(load#" in again._jdf.queryExecution().toString()
    assert refresh_states(df, again, "load", ["pack"], CHECKS, ["x", "h"]).count() == 10
    assert refresh_states(df, kept, "load", ["pack"], CHECKS, ["x", "h"], listed=0).count() == 10


def test_control_limits(spark):
    per = [[(None if i < n else 0.5, "0f0f") for i in range(100)] for n in (10, 12, 11, 60, 11)]
    s = compare_loads(column_states(loads(spark, per), ["pack", "load"], CHECKS, ["x"]), "pack", "load")
    got = {r.load: r.null_share_out for r in control_limits(s, "pack", "load", "null_share").collect()}
    assert got == {0: None, 1: None, 2: False, 3: True, 4: False}


READINGS = "k string, timestamp timestamp, bar_step string, v double, id int, slot int, _us int"


def series(spark, rows):
    return spark.createDataFrame([(k, None if h is None else T0 + timedelta(hours=h), s, v, i, 1, 1) for i, (k, h, s, v) in enumerate(rows)], READINGS)


def brute(readings, step, kind, longest):
    """(slot -> [n, covered, value]) of one series of (seconds, value), by intervals; values that are None are no readings."""
    out = {}
    times = sorted({t for t, _ in readings})
    for t, _ in readings:
        out.setdefault(t // step, [0, 0.0, None, 0.0])[0] += 1

    def spread(chain, use):
        for (a, x), (b, y) in zip(chain, chain[1:]):
            for slot in range(int(a // step), int((b - 1e-9) // step) + 1):
                o = min(b, (slot + 1) * step) - max(a, slot * step)
                if o > 0:
                    use(out.setdefault(slot, [0, 0.0, None, 0.0]), o, a, b, x, y)

    def cover(cell, o, a, b, x, y):
        cell[1] += o if b - a <= longest * step else 0

    def value(cell, o, a, b, x, y):
        if kind == "counter":
            cell[2] = (cell[2] or 0.0) + (y - x if y >= x else y) * o / (b - a)
        elif b - a <= longest * step:
            cell[2], cell[3] = (cell[2] or 0.0) + x * o, cell[3] + o

    spread([(t, None) for t in times], cover)
    spread(sorted((t, x) for t, x in readings if x is not None), value)
    return {s: (c[0], c[1], c[2] if kind == "counter" or c[2] is None else c[2] / c[3]) for s, c in out.items()}


def test_series_against_brute_force(spark):
    import random

    random.seed(5)
    per = {k: [(int(h * 3600), None if random.random() < 0.2 else float(random.randint(0, 50))) for h in {round(random.choice([0, 50, 400]) + random.random() * 30, 2) for _ in range(60)}] for k in "abc"}
    rows = [(k, t / 3600, "1h", v) for k, x in per.items() for t, v in x]
    at = int(T0.timestamp())
    odd = [("a", None, "1h", 1.0), (None, 1.0, "1h", 1.0), ("a", 2.0, "soon", 1.0), ("d", 5.0, "1h", 1.0)]
    for kind in ("gauge", "counter"):
        for chunk in (8, 1024):
            got = {}
            for r in grid_series(series(spark, rows + odd), ["k"], ["v"], id_col="id", kind=kind, chunk=chunk).collect():
                assert (r.k, (r.slot_s - at) // 3600) not in got
                got[r.k, (r.slot_s - at) // 3600] = (r.n_readings, r.covered_s, r.v)
            want = {(k, s): c for k, x in per.items() for s, c in brute(x, 3600, kind, 2.0).items()} | {("d", 5): (1, 0.0, None)}
            assert set(got) == set(want)
            for cell, (n, c, v) in want.items():
                assert got[cell][0] == n and abs(got[cell][1] - c) < 1e-6 and (v is None) == (got[cell][2] is None) and abs((v or 0) - (got[cell][2] or 0)) < 1e-6, (kind, chunk, cell, got[cell], (n, c, v))
    assert grid_series(series(spark, []), ["k"], ["v"]).count() == 0


def test_long_gaps_keep_the_counters_total(spark):
    rows = [("a", 0.0, "1h", 0.0), ("a", 0.5, "1h", 10.0), ("a", 5.5, "1h", 60.0), ("a", 5.75, "1h", 3.0)]
    out = grid_series(series(spark, rows), ["k"], ["v"], kind="counter").collect()
    assert abs(sum(r.v for r in out) - 63.0) < 1e-9 and sum(r.state == "missing" for r in out) == 4


def test_missing_periods_come_from_consecutive_readings(spark, monkeypatch):
    """Ablation: without the difference of a reading and the next one there are no periods but those with readings."""
    rows = [("a", 0.0, "1h", 1.0), ("a", 7.5, "1h", 2.0)]
    assert grid_series(series(spark, rows), ["k"], []).where("n_readings = 0").count() == 6
    monkeypatch.setattr(gridding, "_following", lambda c, by: F.lit(None).cast("struct<_us:bigint,x:double>"))
    assert grid_series(series(spark, rows), ["k"], []).where("n_readings = 0").count() == 0


def test_gauge_and_counter(spark):
    rows = [("a", 0.0, "1h", 10.0), ("a", 0.5, "1h", 20.0), ("a", 2.25, "1h", 5.0), ("a", 9.0, "1h", 6.0), ("a", 9.5, "1h", None), ("a", 9.5, "1h", 1.0)]
    at = int(T0.timestamp())
    for chunk in (2, 1024):
        g = {(r.slot_s - at) // 3600: r for r in grid_series(series(spark, rows), ["k"], ["v"], id_col="id", chunk=chunk).collect()}
        assert sorted(g) == list(range(10)) and [g[i].state for i in range(10)] == ["read", "filled", "read", *["missing"] * 6, "read"]
        assert abs(g[0].v - 15.0) < 1e-9 and abs(g[1].v - 20.0) < 1e-9 and g[5].v is None and g[9].n_readings == 3
        c = {(r.slot_s - at) // 3600: r for r in grid_series(series(spark, rows), ["k"], ["v"], id_col="id", kind="counter", chunk=chunk).collect()}
        # +10 in the first half hour; the fall to 5 is a reset, spread over 1.75 h; +1 over the long gap; 6 to 1 is a reset
        assert abs(c[0].v - (10 + 5 * 0.5 / 1.75)) < 1e-9 and abs(c[1].v - 5 / 1.75) < 1e-9 and abs(c[2].v - 5 * 0.25 / 1.75 - 0.75 / 6.75) < 1e-9 and abs(c[5].v - 1 / 6.75) < 1e-9 and abs(c[9].v - 1.0) < 1e-9
