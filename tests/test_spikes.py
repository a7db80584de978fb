from datetime import datetime, timedelta

import numpy as np
import pytest

from barloom.operators import spikes
from barloom.operators.spikes import SpikeRules, find_implausible, low_rank

SCHEMA = "bar_id bigint, source string, bar_step string, timestamp timestamp, low double, high double, close double, volume double, ingested_at timestamp, _us int, _block string, field string"
START = datetime(2024, 1, 1)


def make(n=400, seed=1, source="a", first=0, hours=1):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    vol = np.exp(rng.normal(3, 0.4, n))
    return [[first + i, source, f"{hours}h", START + timedelta(hours=hours * i), None, None, float(close[i]), float(vol[i]), START + timedelta(hours=hours * i + 1), 1, "x", "y"] for i in range(n)]


def found(spark, rows, rules=SpikeRules()):
    return {(r.bar_id, r.field) for r in find_implausible(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), rules).collect()}


def test_spikes_stuck_and_ranges(spark):
    rows = make()
    for i in (50, 51, 52):
        rows[i][6] *= 3
    rows[100][6] *= 10
    rows[102][6] *= 10
    for i in range(150, 156):
        rows[i][6] *= 3  # six bars: no spike
    for i in range(200, 400):
        rows[i][6] *= 2  # a move that lasts
    top = max(r[7] for r in rows)
    rows[60][7] = top * 9
    for i in range(261, 275):
        rows[i][6] = rows[260][6]
    rows[300][6], rows[301][6], rows[302][7], rows[303][6], rows[304][7] = float("nan"), -1.0, -2.0, float("inf"), None
    rows[305][4], rows[305][5] = rows[305][6] * 1.01, rows[305][6] * 1.02
    want = {(i, "close") for i in (50, 51, 52, 100, 102, 300, 301, 303, 305, *range(261, 275))} | {(60, "volume"), (302, "volume")}
    assert found(spark, rows) == want


def test_blocks_give_the_same(spark):
    rows = make(600, 3)
    for i in (0, 95, 96, 97, 191, 192, 400):
        if i:
            rows[i][6] *= 5
    for i in range(280, 300):
        rows[i][6] = rows[279][6]
    assert found(spark, rows) == found(spark, rows, SpikeRules(block=96)) == {(i, "close") for i in (95, 96, 97, 191, 192, 400, *range(280, 300))}


def test_repeated_and_corrected_rows(spark):
    rows = make()
    wrong = list(rows[70])
    wrong[0], wrong[6] = 9000, rows[70][6] * 4
    rows[70][8] += timedelta(days=1)  # the right value came later
    twice = list(wrong)
    twice[0] = 9001
    assert found(spark, [*rows, wrong, twice]) == {(9000, "close"), (9001, "close")}


def test_nulls_empty_and_tiny(spark):
    assert found(spark, []) == set()
    rows = make(3)
    rows[0][1], rows[1][3], rows[0][6] = None, None, -5.0
    assert found(spark, rows) == {(0, "close")}
    flat = make(40)
    for r in flat:
        r[2], r[8] = None, None
    assert found(spark, flat) == set()


def test_low_rank_leaves_spikes_out():
    rng = np.random.default_rng(0)
    y = np.outer(rng.uniform(1, 2, 30), np.sin(np.arange(24) / 4)) + rng.normal(0, 0.01, (30, 24))
    z = y.copy()
    z[5, 7] += 50
    low = low_rank(z, np.ones_like(z, bool), 1, 6, 0.1)
    assert abs(low[5, 7] - y[5, 7]) < 0.2


@pytest.mark.parametrize("hours", [0.25, 24, 168])
def test_short_daily_and_weekly_bars(spark, hours):
    rows = make(120, 4, hours=hours)
    for r in rows:
        r[2] = {0.25: "15m", 24: "1d", 168: "1w"}[hours]
    rows[40][6] *= 4
    rows[77][7] = max(r[7] for r in rows) * 9
    assert found(spark, rows) == {(40, "close"), (77, "volume")}


def test_neighbours_beyond_long_gaps(spark):
    """Bars around a block count however far away they are, and blocks without bars don't part a run."""
    rows = make(40, 6)
    for i, r in enumerate(rows):
        r[3] = START + timedelta(days=70 * i)
        if i > 0:
            r[6] = rows[0][6] * (1 + 0.001 * (i % 3))
    rows[20][6] *= 3
    for i in range(25, 38):
        rows[i][6] = rows[25][6]
    want = {(20, "close")} | {(i, "close") for i in range(26, 38)}
    assert found(spark, rows) == found(spark, rows, SpikeRules(block=100_000)) == want


def test_the_sparse_rest_decides(spark, monkeypatch):
    """Ablation: with a low-rank part that takes everything in, nothing is sparse and no spike is left; without one, all is sparse."""
    rows = make()
    rows[50][6] *= 3
    rows[60][7] = max(r[7] for r in rows) * 9
    assert found(spark, rows) == {(50, "close"), (60, "volume")}
    table = lambda r: {"us": np.array([int(x[3].timestamp()) * 10**6 for x in r]), "close": np.array([x[6] for x in r]), "volume": np.array([x[7] for x in r])}
    t = table(rows)
    normal = spikes.close_normal(t["us"], np.log(t["close"]), 3600, 0.002, SpikeRules())
    assert np.flatnonzero(np.abs(np.log(t["close"]) - normal) > 0.02).tolist() == [50]
    low, scale = spikes.volume_rest(t["us"], t["volume"], 3600, SpikeRules())
    assert np.log1p(t["volume"] / scale)[60] - low[60] > 0.6
    monkeypatch.setattr(spikes, "low_rank", lambda y, known, rank, rounds, floor: y)
    assert np.abs(np.log1p(t["volume"] / scale) - spikes.volume_rest(t["us"], t["volume"], 3600, SpikeRules())[0]).max() == 0
    monkeypatch.setattr(spikes, "_running_median", lambda x, half: np.zeros(len(x)))
    assert np.abs(np.log(t["close"]) - spikes.close_normal(t["us"], np.log(t["close"]), 3600, 0.002, SpikeRules())).max() < 1e-12
