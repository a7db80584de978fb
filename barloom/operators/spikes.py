"""Implausible readings: impossible values, stuck runs and spikes, relative to a source's own normal behaviour.

A source's series is cut into blocks of days. In each block, robust principal components of the daily profile matrix (days x
periods of the day; weeks x days for daily bars) part a low-rank normal behaviour from a sparse rest. The sparse rest decides on
spikes: of the close by its size in usual moves; of the volume by what it leaves over as the largest ordinary volume of the
source. A test of the neighbours only confirms that a spike is short. Stuck runs and ranges are tested apart. Each block is told
the last and first bars around it, so that no test stops at a border, and no task holds more than a block of a source, however
many rows the source has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.gridding import step_seconds
from barloom.session import cut_lineage


@dataclass(frozen=True)
class SpikeRules:
    """close_moves: usual moves by which a spike of the close leaves the low-rank part. volume_times: times the largest ordinary
    volume. sparse: the logarithm by which a volume exceeds the low-rank part to be sparse. longest: bars that a spike lasts at
    most. stuck: bars of a stuck run at least. block: bars of a block, of seven days at least. half: bars on each side of which the
    close's level is the median. rank, rounds: of the low-rank part."""

    close_moves: float = 10.0
    volume_times: float = 4.0
    sparse: float = 0.6
    longest: int = 3
    stuck: int = 12
    block: int = 4096
    half: int = 3
    rank: int = 2
    rounds: int = 6

    @property
    def edge(self) -> int:
        """Bars around a block that decide on its own bars."""
        return self.stuck + self.half + self.longest + 1


def impossible() -> tuple[Column, Column]:
    """Whether a row's close and volume can't be: NaN, infinite, a close not above 0 or outside its row's low..high, a negative
    volume. False for nulls."""
    real = lambda c: c.isNotNull() & ~F.isnan(c)
    c, v, lo, hi = (F.col(n).cast("double") for n in ("close", "volume", "low", "high"))
    inf = lambda x: F.abs(x) == float("inf")
    close = F.isnan(c) | inf(c) | (c <= 0) | (real(lo) & (c < lo)) | (real(hi) & (c > hi))
    return F.coalesce(c.isNotNull() & close, F.lit(False)), F.coalesce(v.isNotNull() & (F.isnan(v) | inf(v) | (v < 0)), F.lit(False))


def low_rank(y: np.ndarray, known: np.ndarray, rank: int, rounds: int, floor: float) -> np.ndarray:
    """The low-rank part of y by alternating projections: sparse entries stand for their low-rank value while y is projected
    onto rank `rank`, then entries far from the projection become the sparse ones. The first sparse entries are those far from
    the median, since a projection that still saw a large spike would take it for a component."""
    days, slots = y.shape
    centre = np.median(y[known])
    low = np.full_like(y, centre)
    for _ in range(rounds):
        rest = np.where(known, y - low, 0.0)
        spread = 1.4826 * np.median(np.abs(rest[known]))
        z = np.where(known & (np.abs(rest) <= max(floor, 3.0 * spread)), y, low)
        gram = z.T @ z if slots <= days else z @ z.T
        top = np.linalg.eigh(gram)[1][:, -rank:]
        low = (z @ top) @ top.T if slots <= days else top @ (top.T @ z)
    return low


def _profile(ts: np.ndarray, y: np.ndarray, step_s: int, rank: int, rounds: int, floor: float) -> np.ndarray:
    """The normal value of each bar: the low-rank part of the profile matrix of the block, days by periods of the day, or weeks by
    days for bars of a day and more. Days and periods without bars take no row or column, so thin grids stay small."""
    day_us, step_us = 86_400_000_000, max(1, step_s) * 1_000_000
    frame = day_us if step_us < day_us else 7 * max(day_us, step_us)
    _, row = np.unique(ts // frame, return_inverse=True)
    _, col = np.unique((ts % frame) // step_us, return_inverse=True)
    n, m = int(row.max()) + 1, int(col.max()) + 1
    grid, known = np.zeros((n, m)), np.zeros((n, m), bool)
    grid[row, col], known[row, col] = y, True
    return low_rank(grid, known, min(rank, n, m), rounds, floor)[row, col]


def _running_median(x: np.ndarray, half: int) -> np.ndarray:
    n = len(x)
    if n <= 2 * half:
        return np.full(n, np.median(x))
    inner = np.median(np.lib.stride_tricks.sliding_window_view(x, 2 * half + 1), axis=1)
    out = np.empty(n)
    out[half : n - half] = inner
    for i in range(half):
        out[i], out[n - 1 - i] = np.median(x[: i + half + 1]), np.median(x[n - 1 - i - half :])
    return out


def _short(far: np.ndarray, bar: int, longest: int, x: np.ndarray | None = None, value: float = 0.0, apart: float = 0.0) -> bool:
    """Whether the bars around `bar` that are far from normal make, with it, a run of at most `longest`, with bars on both sides;
    with x also whether `value` is `apart` from both of them, as it isn't where prices ran up to it or on from it."""
    lo = hi = bar
    while lo > 0 and far[lo - 1] and bar - lo < longest:
        lo -= 1
    while hi + 1 < len(far) and far[hi + 1] and hi - bar < longest:
        hi += 1
    if hi - lo >= longest or lo == 0 or hi + 1 == len(far):
        return False
    return x is None or (abs(value - x[lo - 1]) > apart and abs(value - x[hi + 1]) > apart)


def _bars(ts: np.ndarray, values: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times and values of the bars (the last usable row of each), and each row's bar; rows are sorted by time and arrival."""
    rows = np.flatnonzero(ok)
    last = np.r_[ts[rows][1:] != ts[rows][:-1], True] if len(rows) else np.zeros(0, bool)
    keep = rows[last]
    return ts[keep], values[keep], np.searchsorted(ts[keep], ts)


def _stuck(x: np.ndarray, least: int) -> np.ndarray:
    """Bars that repeat the bar before in a run of at least `least` bars."""
    same = np.r_[False, x[1:] == x[:-1]]
    start = np.maximum.accumulate(np.where(~same, np.arange(len(x)), 0))
    length = np.bincount(start, minlength=len(x))[start]
    return same & (length >= least)


_STATS = pa.schema([("source", pa.string()), ("_block", pa.int64()), ("kind", pa.string()), ("bin", pa.int32()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("us", pa.list_(pa.int64())), ("x", pa.list_(pa.float64()))])
_STATS_DDL = "source string, _block bigint, kind string, bin int, n bigint, lo double, hi double, us array<bigint>, x array<double>"


def _columns(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The named columns, sorted by time, arrival and id."""
    col = {c: table[c].to_numpy() for c in names}
    order = np.lexsort((col["bar_id"], col["_seen"], col["_us"]))
    return {c: v[order] for c, v in col.items()}


def _bins(x: np.ndarray, per_octave: int) -> list[tuple[int, int, float, float]]:
    """(bin, n, least, greatest) of positive numbers in equal bins of their logarithm."""
    if not len(x):
        return []
    x = np.sort(x)
    bins = np.floor(np.log2(x) * per_octave).astype(np.int64)
    at = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    end = np.r_[at[1:], len(x)]
    return [(int(bins[i]), int(j - i), float(x[i]), float(x[j - 1])) for i, j in zip(at, end)]


def _usable(value: np.ndarray, field: str) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.isfinite(value) & ((value > 0) if field == "close" else (value >= 0))


def volume_rest(at: np.ndarray, x: np.ndarray, step: int, rules: SpikeRules) -> tuple[np.ndarray, float]:
    """The low-rank part of the bars' volumes, as ln(1 + volume / scale), and the scale."""
    scale = float(np.median(x[x > 0])) if (x > 0).any() else 1.0
    return _profile(at, np.log1p(x / scale), step, rules.rank, rules.rounds, rules.sparse), scale


def close_normal(at: np.ndarray, logs: np.ndarray, step: int, move: float, rules: SpikeRules) -> np.ndarray:
    """The normal logarithm of the bars' closes: the local level and the low-rank part of what it leaves."""
    base = _running_median(logs, rules.half)
    return base + _profile(at, logs - base, step, 1, rules.rounds, 4 * move)


def _block_stats(rules: SpikeRules):
    """What a block tells its source and its neighbours: a histogram of its moves, the range of its ordinary volumes (those in the
    low-rank part), a histogram of its sparse ones, and its first and last bars. The block itself is one row, with n = 0."""

    def stats(table: pa.Table) -> pa.Table:
        source, block = table["source"][0].as_py(), table["_block"][0].as_py()
        col = _columns(table, ("bar_id", "_us", "_seen", "close", "volume", "_step"))
        step = int(col["_step"][0])
        rows = [("block", 0, 0, 0.0, 0.0, None, None)]
        for field in ("close", "volume"):
            value = col[field].astype(float)
            ok = _usable(value, field)
            at, x, bar = _bars(col["_us"], value, ok)
            if not len(x):
                continue
            for side, part in (("head", slice(None, rules.edge)), ("tail", slice(-rules.edge, None))):
                rows.append((f"{side}_{field}", 0, 0, 0.0, 0.0, at[part].tolist(), x[part].tolist()))
            if field == "close":
                moves = np.abs(np.diff(np.log(x)))
                rows += [("move", *b, None, None) for b in _bins(moves[moves > 0], 32)]
                continue
            normal, scale = volume_rest(at, x, step, rules)
            own = np.flatnonzero(ok)  # each row by its own value, corrected ones too
            v = value[own]
            far = np.log1p(v / scale) - normal[bar[own]] > rules.sparse
            if (~far).any():
                rows.append(("ordinary", 0, int((~far).sum()), float(v[~far].min()), float(v[~far].max()), None, None))
            rows += [("sparse", *b, None, None) for b in _bins(v[far & (v > 0)], 8)]
        return pa.Table.from_arrays([pa.array([source] * len(rows), pa.string()), pa.array([block] * len(rows), pa.int64()), *[pa.array([r[i] for r in rows], _STATS.field(i + 2).type) for i in range(7)]], schema=_STATS)

    return stats


def _block_finder(rules: SpikeRules):
    out = pa.schema([("bar_id", pa.int64()), ("field", pa.string())])

    def find(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        col = _columns(table, ("bar_id", "_us", "_seen", "close", "volume", "_step", "_bad_close", "_bad_volume"))
        known = told.to_pylist()[0]
        step = int(col["_step"][0])
        ids, fields = [], []

        def report(hit: np.ndarray, field: str) -> None:
            ids.append(col["bar_id"][hit])
            fields.extend([field] * int(hit.sum()))

        for field in ("close", "volume"):
            bad = col[f"_bad_{field}"].astype(bool)
            report(bad, field)
            value = col[field].astype(float)
            ok = _usable(value, field)
            at, x, bar = _bars(col["_us"], value, ok)
            if not len(x):
                continue
            ahead, behind = known[f"before_{field}"] or [], known[f"after_{field}"] or []
            at = np.concatenate((np.array([b["us"] for b in ahead], np.int64), at, np.array([b["us"] for b in behind], np.int64)))
            x = np.concatenate((np.array([b["x"] for b in ahead], float), x, np.array([b["x"] for b in behind], float)))
            bar = np.minimum(bar + len(ahead), len(x) - 1)
            own = ok & (at[bar] == col["_us"])
            stuck = own & ~bad & _stuck(x, rules.stuck)[bar] & (value == x[bar])
            report(stuck, field)
            hit = np.zeros(len(value), bool)
            if field == "close":
                move = known["_move"]
                if move and np.isfinite(move):
                    logs = np.log(x)
                    normal = close_normal(at, logs, step, move, rules)
                    limit = rules.close_moves * move
                    rest = np.log(np.where(own, value, 1.0)) - normal[bar]
                    far = np.abs(logs - normal) > limit
                    for i in np.flatnonzero(own & (np.abs(rest) > limit)):
                        hit[i] = _short(far, bar[i], rules.longest, logs, float(np.log(value[i])), limit / 2)
            else:
                most = known["_most"]
                if most and np.isfinite(most):
                    normal, scale = volume_rest(at, x, step, rules)
                    rest = np.log1p(np.where(own, value, 0.0) / scale) - normal[bar]
                    far = (np.log1p(x / scale) - normal > rules.sparse) & (x > rules.volume_times * most)
                    for i in np.flatnonzero(own & (rest > rules.sparse) & (value > rules.volume_times * most)):
                        hit[i] = _short(far, bar[i], rules.longest)
            report(hit & ~bad & ~stuck, field)
        return pa.table({"bar_id": np.concatenate(ids) if ids else np.zeros(0, np.int64), "field": pa.array(fields, pa.string())}, schema=out)

    return find


def _source_stats(stats: DataFrame, times: float) -> DataFrame:
    """(source, _move, _most): the median of a source's moves that aren't zero, and its largest ordinary volume: that of the
    low-rank part, or of sparse volumes that it leads up to, each at most `times` the one before."""
    binned = stats.groupBy("source", "kind", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    w = Window.partitionBy("source", "kind").orderBy("bin")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = binned.withColumns({"_upto": upto, "_all": F.sum("n").over(Window.partitionBy("source", "kind")), "_before": F.lag("hi").over(w), "_plain": F.max(F.when(F.col("kind") == "ordinary", F.col("hi"))).over(Window.partitionBy("source"))})
    jump = F.col("lo") > F.greatest("_plain", "_before") * times
    x = x.withColumn("_jumps", F.sum(F.coalesce(jump, F.lit(False)).cast("int")).over(w))
    middle = (F.col("kind") == "move") & (F.col("_upto") * 2 >= F.col("_all")) & ((F.col("_upto") - F.col("n")) * 2 < F.col("_all"))
    inside = (F.col("_all") / 2 - (F.col("_upto") - F.col("n"))) / F.col("n")
    led = (F.col("kind") == "ordinary") | ((F.col("kind") == "sparse") & (F.col("_jumps") == 0) & F.col("_plain").isNotNull())
    return x.groupBy("source").agg(F.max(F.when(middle, F.col("lo") + (F.col("hi") - F.col("lo")) * inside)).alias("_move"), F.max(F.when(led, F.col("hi"))).alias("_most"))


def _around(edges: DataFrame, k: int, stretch: int = 1024) -> DataFrame:
    """(source, field, _block, before, after): the last k bars before a block and the first k after it. edges: a row for each block
    with bars, with its first and last ones in `head` and `tail`. Windows run over stretches of blocks, then over stretches."""
    keys = ["source", "field"]
    x = edges.withColumn("_s", F.expr(f"_block div {stretch}"))
    near, far = Window.partitionBy(*keys, "_s").orderBy("_block"), Window.partitionBy(*keys).orderBy("_s")
    last = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - k + 1), k)
    ahead = lambda w, c: F.flatten(F.collect_list(c).over(w.rowsBetween(-k, -1)))
    behind = lambda w, c: F.flatten(F.collect_list(c).over(w.rowsBetween(1, k)))
    x = x.withColumns({"_b": ahead(near, "tail"), "_a": behind(near, "head")})
    whole = x.groupBy(*keys, "_s").agg(F.sort_array(F.collect_list(F.struct("_block", "head", "tail"))).alias("_all"))  # stretch x k bars at most
    whole = whole.select(*keys, "_s", F.slice(F.flatten("_all.head"), 1, k).alias("_head"), last(F.flatten("_all.tail")).alias("_tail"))
    whole = whole.select(*keys, "_s", ahead(far, "_tail").alias("_bb"), behind(far, "_head").alias("_aa"))
    x = x.join(whole, [*keys, "_s"])
    return x.select(*keys, "_block", last(F.concat("_bb", "_b")).alias("before"), F.slice(F.concat("_a", "_aa"), 1, k).alias("after"), "head")


def find_implausible(df: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """(bar_id, field): each close or volume reading that can't be right, once; the same for any size of the blocks, but for what
    the low-rank part of other days gives.

    df: bar_id, source, bar_step, timestamp, low, high, close, volume, ingested_at; other columns are ignored. Null readings
    are never reported. Rows of one source and time are one bar, which stands for its last usable row; each row is judged by
    its own value. Bars without a usable value are left out of the series. Rows without source or timestamp are only tested
    for the range; a bar_step that isn't an interval counts as one hour. An empty table gives an empty result.
    """
    bad_close, bad_volume = impossible()
    number = lambda c: F.col(c).cast("double").alias(c)
    rows = df.where(F.col("source").isNotNull() & F.col("timestamp").isNotNull()).select(
        F.col("bar_id").cast("bigint").alias("bar_id"), "source", F.unix_micros("timestamp").alias("_us"), F.coalesce(F.unix_micros("ingested_at"), F.lit(0)).alias("_seen"),
        number("close"), number("volume"), F.coalesce(step_seconds(F.col("bar_step")), F.lit(3600)).alias("_step"), bad_close.alias("_bad_close"), bad_volume.alias("_bad_volume"),
    )
    days = F.greatest(F.lit(7), F.floor(F.lit(rules.block) * F.col("_step") / 86400))
    rows = rows.withColumn("_span", (days * 86_400_000_000).cast("bigint")).withColumn("_block", F.expr("(_us - pmod(_us, _span)) div _span")).drop("_span")

    # Two passes over the blocks: what is usual for a source, then its readings. One row for each block carries what the second
    # pass has to know; it meets the block's rows in their group, not in each row.
    stats = cut_lineage(rows.groupBy("source", "_block").applyInArrow(_block_stats(rules), _STATS_DDL))
    edges = stats.where("kind rlike '^(head|tail)_'").groupBy("source", F.substring("kind", 6, 6).alias("field"), "_block").agg(*[F.max(F.when(F.col("kind").startswith(s), F.arrays_zip("us", "x"))).alias(s) for s in ("head", "tail")])
    around = _around(edges, rules.edge)
    # The move from a block's last bar to the next block's first counts as well.
    gap = F.abs(F.ln(F.element_at("after", 1)["x"]) - F.ln(F.element_at("own", -1)["x"]))
    step_over = around.join(edges.select("source", "field", "_block", F.col("tail").alias("own")), ["source", "field", "_block"]).where((F.col("field") == "close") & (F.size("after") > 0)).select("source", "_block", F.lit("move").alias("kind"), gap.alias("lo")).where("lo > 0")
    step_over = step_over.select("source", "_block", "kind", F.floor(F.log2("lo") * 32).cast("int").alias("bin"), F.lit(1).cast("bigint").alias("n"), "lo", F.col("lo").alias("hi"))
    usual = _source_stats(stats.where("n > 0").drop("us", "x").unionByName(step_over), rules.volume_times)
    told = around.groupBy("source", "_block").agg(*[F.max(F.when(F.col("field") == f, F.col(s))).alias(f"{s}_{f}") for f in ("close", "volume") for s in ("before", "after")])
    told = stats.where("kind = 'block'").select("source", "_block").join(told, ["source", "_block"], "left").join(usual, "source", "left")
    series = rows.groupBy("source", "_block").cogroup(told.groupBy("source", "_block")).applyInArrow(_block_finder(rules), "bar_id bigint, field string")
    loose = df.where(F.col("source").isNull() | F.col("timestamp").isNull()).select("bar_id", F.explode(F.filter(F.array(F.when(bad_close, F.lit("close")), F.when(bad_volume, F.lit("volume"))), lambda x: x.isNotNull())).alias("field"))
    return series.unionByName(loose)
