"""Irregular readings onto a regular grid.

Readings are cumulative counters, or gauges turned into one (the running integral of value over time). Consecutive readings are
differenced, a fall marks a reset, each increment is spread over the grid cells it overlaps in proportion to the overlap, and
cells that no interval covers are marked.

No window runs over a whole series: readings are ordered within one cell, cells within chunks, and only one summary row for each
chunk crosses chunk borders. A series that holds a third of all rows is thus as parallel as many small ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of the units of an interval text.
UNIT_S = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def step_seconds(text: Column) -> Column:
    """Seconds of an interval text such as `30m` or `4h`; null for any other text."""
    units = F.create_map(*[F.lit(x) for kv in UNIT_S.items() for x in kv])
    n = F.regexp_extract(text, r"^\s*(\d{1,6})\s*([smhdwSMHDW])\s*$", 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(text, r"^\s*(\d{1,6})\s*([smhdwSMHDW])\s*$", 2))
    return F.when(n > 0, n * F.try_element_at(units, unit))


def _slots(df: DataFrame, keys: Sequence[str], time_col: str, step_col: str) -> DataFrame:
    """Keys, _step, _slot and _us of the rows that belong to a series and have a time and a step."""
    some = [F.col(f"`{k}`").isNotNull() for k in (*keys, time_col)]
    for c in some:
        df = df.where(c)
    own = df.select(*[F.col(f"`{k}`") for k in keys], F.unix_micros(F.col(f"`{time_col}`").cast("timestamp")).alias("_us"), step_seconds(F.col(f"`{step_col}`")).alias("_step"), *[F.col(f"`{c}`").alias(f"_v_{c}") for c in df.columns if c not in (*keys, time_col, step_col)])
    return own.where(F.col("_step").isNotNull()).withColumn("_slot", F.expr("(_us - pmod(_us, _step * 1000000)) div (_step * 1000000)"))


def _chunk_of(slot: str, chunk: int) -> Column:
    return F.expr(f"({slot} - pmod({slot}, {chunk})) div {chunk}")


def _following(struct: Column, by: Window) -> Column:
    """The next value that isn't null after a row; by: a window in falling order."""
    return F.last(struct, True).over(by.rowsBetween(Window.unboundedPreceding, -1))


def _preceding(struct: Column, by: Window) -> Column:
    """The last value that isn't null before a row; by: a window in rising order."""
    return F.last(struct, True).over(by.rowsBetween(Window.unboundedPreceding, -1))


def _beyond(df: DataFrame, keys: list[str], chunk: str, at: str, readings: Sequence[str]) -> DataFrame:
    """df, whose rows hold the first (`_f_*`) and last (`_l_*`) reading of a period, with `_p_*` and `_q_*`: the last reading before
    the period and the first after it. Windows run over chunks of periods; one row for each chunk tells its neighbours what they
    need."""
    up, down = Window.partitionBy(*keys, chunk).orderBy(at), Window.partitionBy(*keys, chunk).orderBy(F.col(at).desc())
    x = df.withColumns({f"_p_{r}": _preceding(F.col(f"_l_{r}"), up) for r in readings} | {f"_q_{r}": _following(F.col(f"_f_{r}"), down) for r in readings})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(at)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at)))
    ends = df.groupBy(*keys, chunk).agg(*[first(f"_f_{r}").alias(f"_h_{r}") for r in readings], *[last(f"_l_{r}").alias(f"_t_{r}") for r in readings])
    up, down = Window.partitionBy(*keys).orderBy(chunk), Window.partitionBy(*keys).orderBy(F.col(chunk).desc())
    ends = ends.select(*keys, chunk, *[_preceding(F.col(f"_t_{r}"), up).alias(f"_pp_{r}") for r in readings], *[_following(F.col(f"_h_{r}"), down).alias(f"_qq_{r}") for r in readings])
    x = x.join(ends, [*keys, chunk])
    return x.withColumns({f"_p_{r}": F.coalesce(f"_p_{r}", f"_pp_{r}") for r in readings} | {f"_q_{r}": F.coalesce(f"_q_{r}", f"_qq_{r}") for r in readings}).drop(*[f"{p}_{r}" for p in ("_pp", "_qq") for r in readings])


def grid_series(df: DataFrame, keys: Sequence[str], values: Sequence[str], time_col: str = "timestamp", step_col: str = "bar_step", id_col: str | None = None, kind: str = "gauge", longest_gap: float = 2.0, chunk: int = 1024) -> DataFrame:
    """One row for each period of a series from its first to its last reading.

    Columns: keys, slot_s, n_readings, covered_s (seconds of the period that lie between two readings at most `longest_gap`
    steps apart), state (`read`: has a reading; `filled`: has none but is covered in part; `missing`: has none and isn't covered),
    and for each value `<value>`. For kind `gauge` that is the time-weighted mean over the part of the period that lies between
    readings at most longest_gap steps apart, the last reading being held until the next one; null where there is no such part.
    For kind `counter` it is the increment that falls into the period: a rise from a reading to the next, or, where the counter
    fell and so was reset, its new value, is spread over all periods between both in proportion to the overlap. No increment is
    lost: those of long gaps are spread as well, into periods marked `missing`; the sum over all periods is that of all increments.

    Every period but those with readings comes from the difference of two consecutive readings, over whose interval it lies.
    Rows with a null key or time, or without a step, belong nowhere. A null or NaN value is no reading of that value, so its
    neighbours follow each other. Of readings at one time the one with the greatest id_col (or value) counts. An empty table
    gives an empty result. Readings are ordered within one period of one series, periods within chunks.
    """
    keys = list(keys)
    source = df.select(*[f"`{c}`" for c in dict.fromkeys((*keys, time_col, step_col, *values, *([id_col] if id_col else [])))])
    s = _slots(source, keys, time_col, step_col)
    # Columns of the steps can't meet the keys' names, which go by their place until the end.
    names = [f"_k{i}" for i in range(len(keys))] + ["_step"]
    s = s.withColumnsRenamed(dict(zip(keys, names)))
    clean = {c: F.when(F.isnan(F.col(f"`_v_{c}`").cast("double")), None).otherwise(F.col(f"`_v_{c}`").cast("double")) for c in values}
    order = F.struct(*([F.col(f"`_v_{id_col}`")] if id_col else [clean[c] for c in values] or [F.lit(0)]))
    # One exchange of the readings, by period; it serves the merging of equal times, the order within a period and its summary.
    r = s.repartition(*names, "_slot").groupBy(*names, "_slot", "_us").agg(F.count("*").alias("_n"), *[F.max_by(clean[c], F.when(clean[c].isNotNull(), order)).alias(f"_x_{i}") for i, c in enumerate(values)])
    width = F.col("_step") * 1_000_000
    # `r` is the presence of any reading, 0.. the values; each is a chain of its own readings.
    chains = ["r", *map(str, range(len(values)))]
    r = r.withColumns({"_c_r": F.struct("_us", F.lit(1.0).alias("x"))} | {f"_c_{i}": F.when(F.col(f"_x_{i}").isNotNull(), F.struct("_us", F.col(f"_x_{i}").alias("x"))) for i in range(len(values))})
    down = Window.partitionBy(*names, "_slot").orderBy(F.col("_us").desc())
    r = r.withColumns({f"_d_{c}": _following(F.col(f"_c_{c}"), down) for c in chains})

    def near(a: Column, b: Column) -> Column:
        return b["_us"] - a["_us"] <= F.lit(float(longest_gap)) * width

    def increment(a: Column, b: Column, overlap: Column) -> Column:
        """The part of the increment from reading a to reading b that falls into an overlap of so many microseconds."""
        if kind == "gauge":  # the counter is the integral of the held value
            return F.when(near(a, b), a["x"] * overlap)
        return F.when(b["x"] >= a["x"], b["x"] - a["x"]).otherwise(b["x"]) * (overlap / (b["_us"] - a["_us"]))

    def held(a: Column, b: Column, overlap: Column) -> Column:
        return F.when(near(a, b), overlap)

    inner = []
    for c in chains:
        a, b = F.col(f"_c_{c}"), F.col(f"_d_{c}")
        o = b["_us"] - a["_us"]
        inner += [F.min_by(f"_c_{c}", F.when(a.isNotNull(), F.col("_us"))).alias(f"_f_{c}"), F.max_by(f"_c_{c}", F.when(a.isNotNull(), F.col("_us"))).alias(f"_l_{c}"), F.sum(increment(a, b, o)).alias(f"_i_{c}"), F.sum(held(a, b, o)).alias(f"_w_{c}")]
    cells = r.groupBy(*names, "_slot").agg(F.sum("_n").alias("_n"), *inner).withColumn("_chunk", _chunk_of("_slot", chunk))
    cells = _beyond(cells, names, "_chunk", "_slot", chains)

    # A period with readings is itself; the periods up to the next one with readings lie in the interval between both.
    cells = cells.withColumn("_until", F.expr("(_q_r._us - pmod(_q_r._us, _step * 1000000)) div (_step * 1000000)"))
    cell = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    spans = F.transform(F.sequence(F.col("_slot") + 1, F.col("_until") - 1, F.lit(chunk).cast("bigint")), lambda a: cell(a, F.least(a + chunk - 1, F.col("_until") - 1)))
    own = F.array(cell(F.col("_slot"), F.col("_slot")))
    x = cells.withColumn("_e", F.explode(F.when(F.col("_until") > F.col("_slot") + 1, F.concat(own, spans)).otherwise(own)))
    x = x.withColumn("slot", F.explode(F.sequence("_e.a", "_e.b"))).withColumn("_own", F.col("slot") == F.col("_slot"))
    start, zero = F.col("slot") * width, F.lit(0).cast("bigint")

    def total(c: str, part, within: str) -> Column:
        """The sum over the intervals of a chain that overlap the period."""
        first, last, before, after = (F.col(f"_{p}_{c}") for p in ("f", "l", "p", "q"))
        ahead = F.coalesce(last, before)  # the reading before a period without one of this chain
        some = lambda v: F.coalesce(v, F.lit(0.0))
        whole = F.when(F.col(f"_q_{c}").isNotNull() & ahead.isNotNull(), part(ahead, after, width))
        sides = some(F.when(before.isNotNull(), part(before, first, first["_us"] - start))) + some(F.when(after.isNotNull(), part(last, after, start + width - last["_us"])))
        any_side = F.col(f"{within}_{c}").isNotNull() | F.when(before.isNotNull(), part(before, first, first["_us"] - start)).isNotNull() | F.when(after.isNotNull(), part(last, after, start + width - last["_us"])).isNotNull()
        return F.when(F.col("_own") & first.isNotNull(), F.when(any_side, some(F.col(f"{within}_{c}")) + sides)).otherwise(whole)

    covered = F.coalesce(total("r", held, "_w"), zero) / 1_000_000
    out = {}
    for i, c in enumerate(values):
        y = total(str(i), increment, "_i")
        out[c] = F.try_divide(y, total(str(i), held, "_w")) if kind == "gauge" else y
    n = F.when(F.col("_own"), F.col("_n")).otherwise(0).cast("bigint")
    state = F.when(n > 0, "read").when(covered > 0, "filled").otherwise("missing")
    return x.select(*[F.col(k).alias(name) for k, name in zip(names, keys)], (F.col("slot") * F.col("_step")).alias("slot_s"), n.alias("n_readings"), covered.cast("double").alias("covered_s"), state.alias("state"), *[y.alias(c) for c, y in out.items()])
