"""Queries of the data-processing operators in the core package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import gridding, profile, schemas, spikes
from barloom.operators import timestamps as ts
from barloom.session import as_table, cut_lineage
from barloom.sources.tables import table


def _p1_texts(spark: SparkSession, d: str) -> DataFrame:
    # Both tables go through one cascade: its expressions are many, so they're compiled once.
    none = F.lit(None).cast("string")
    k = table(spark, d, "klines_raw").select("raw_id", "feed_id", "received_at", F.col("open_time").alias("a"), none.alias("b"), none.alias("c"))
    f = table(spark, d, "funding_raw").select("raw_id", "feed_id", "received_at", F.col("timestamp").alias("a"), F.col("fundingTime").alias("b"), F.col("funding_time_utc").alias("c"))
    x = ts.normalize_timestamps(k.unionByName(f), table(spark, d, "feeds"), {"a": None, "b": None, "c": "UTC"})
    texts = [F.col(f"{c}_instant") for c in "cba"]
    return x.select("raw_id", F.array(*texts).alias("texts"), ts.agreed_instant(texts).alias("utc_us"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of klines_raw and funding_raw whose text names an instant, with that instant in microseconds."""
    return _p1_texts(spark, d).where(F.col("utc_us").isNotNull()).select("raw_id", "utc_us")


def p1_formats(spark: SparkSession, d: str) -> DataFrame:
    """How many texts each pattern of the cascade read, by outcome."""
    return _p1_texts(spark, d).select(F.explode("texts").alias("x")).where(F.col("x").isNotNull()).groupBy(F.coalesce("x.pattern", F.lit("none")).alias("pattern"), F.col("x.status").alias("status")).agg(F.count("*").alias("n"))


#: What the observation pack's columns must satisfy.
PACK_CHECKS = {
    "p_max_filter": profile.Check(0.333, 1.0),
    "effective_num_states_filter": profile.Check(1.0, 3.0),
    "expected_state_filter": profile.Check(0.0, 2.0),
    "p_margin_filter": profile.Check(0.0, 1.0),
    "digest": profile.Check(pattern="[0-9a-f]{12}"),
}


def _p5_compared(spark: SparkSession, d: str, columns: list[str] | None) -> DataFrame:
    """The loads of each pack compared, from states of single files that are merged."""
    pack = table(spark, d, "rl_observation_pack").withColumn("_file", F.input_file_name())
    names = columns or [c for c in pack.columns if c not in ("pack_id", "load_id", "_file")]
    files = profile.refresh_states(pack, None, "_file", ["pack_id", "load_id"], PACK_CHECKS, names)
    return profile.compare_loads(cut_lineage(profile.merge_states(files, ["pack_id", "load_id"])), "pack_id", "load_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Where the five checked columns of a load fall out of line."""
    return profile.findings(_p5_compared(spark, d, list(PACK_CHECKS)), "load_id", PACK_CHECKS)


def p5_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same after the newest load of each pack has come: states of the earlier loads are kept, only the new loads are read."""
    pack = table(spark, d, "rl_observation_pack")
    newest = pack.groupBy("pack_id").agg(F.max("load_id").alias("load_id"))
    before = pack.join(newest, ["pack_id", "load_id"], "left_anti")
    kept = as_table(profile.refresh_states(before, None, "load_id", ["pack_id"], PACK_CHECKS, list(PACK_CHECKS)), "states")
    states = cut_lineage(profile.refresh_states(pack, kept, "load_id", ["pack_id"], PACK_CHECKS, list(PACK_CHECKS)))
    return profile.findings(profile.compare_loads(states, "pack_id", "load_id"), "load_id", PACK_CHECKS)


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column for each load, with its change against the other loads of the pack and against the limits that
    the earlier ones set."""
    x = _p5_compared(spark, d, None)
    for metric in ("null_share", "distinct_share"):
        x = profile.control_limits(x, "pack_id", "load_id", metric)
    change, shares = F.col("null_share") - F.col("usual_null_share"), [F.round(f"{m}_{side}", 6).alias(f"{m}_{side}") for m in ("null_share", "distinct_share") for side in ("low", "high")]
    return x.select(
        "pack_id", "load_id", "column_name", "n_rows", F.col("null_share").alias("null_rate"), F.hll_sketch_estimate("distinct_state").alias("distinct_count"), "low", "high", "n_out", "n_bad",
        F.round(change, 6).alias("null_change"), F.round("shifted_from", 6).alias("shifted_from"), *shares, "null_share_out", "distinct_share_out",
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods of the regular series without a reading, be they filled or marked as missing."""
    return p7_series(spark, d).where("n_readings = 0").select("pack_id", "segment", "slot_s")


def p7_counters(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type in each hour, from a cumulative counter that starts anew every day and is read at irregular times: at
    the last event of each five minutes that have one."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").where(F.col("ts").isNotNull() & F.col("event_type").isNotNull()).select("event_type", us.alias("us"), F.expr("unix_micros(cast(ts as timestamp)) div 300000000").alias("bucket"))
    e = e.groupBy("event_type", "bucket").agg(F.count("*").alias("n"), F.max("us").alias("us"))
    day = Window.partitionBy("event_type", F.expr("bucket div 288")).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # 288 rows at most
    readings = e.select("event_type", F.timestamp_micros("us").alias("timestamp"), F.lit("1h").alias("bar_step"), F.sum("n").over(day).alias("n_events"))
    s = gridding.grid_series(readings, ["event_type"], ["n_events"], kind="counter")
    return s.withColumns({"covered_s": F.round("covered_s", 6) + 0.0, "n_events": F.round("n_events", 5) + 0.0})


def p7_series(spark: SparkSession, d: str) -> DataFrame:
    """One row for each period of each pack and segment; the summaries are gauges, their missing periods filled or marked."""
    x = gridding.grid_series(table(spark, d, "rl_observation_pack"), ["pack_id", "segment"], _GAUGES, id_col="obs_id")
    return x.withColumns({c: F.round(c, 9) + 0.0 for c in _GAUGES} | {"covered_s": F.round("covered_s", 6) + 0.0})


QUERIES = {"p1_found": p1_found, "p1_formats": p1_formats, "p5_found": p5_found, "p5_incremental": p5_incremental, "p5_profile": p5_profile, "p7_found": p7_found, "p7_series": p7_series, "p7_counters": p7_counters}
ORACLES: dict[str, str] = {}

ORACLES["p7_found"] = """
WITH r AS (
  SELECT pack_id, segment, CASE bar_step WHEN '30m' THEN 1800 WHEN '1h' THEN 3600 WHEN '4h' THEN 14400 WHEN '8h' THEN 28800 END AS step,
         epoch_us("timestamp") // 1000000 AS s
  FROM rl_observation_pack WHERE pack_id IS NOT NULL AND segment IS NOT NULL AND "timestamp" IS NOT NULL),
h AS (SELECT DISTINCT pack_id, segment, step, s // step AS slot FROM r WHERE step IS NOT NULL),
g AS (SELECT pack_id, segment, step, unnest(a) AS slot FROM (SELECT pack_id, segment, step, generate_series(min(slot), max(slot)) AS a FROM h GROUP BY 1, 2, 3))
SELECT pack_id, segment, CAST(slot * step AS BIGINT) AS slot_s FROM (SELECT * FROM g EXCEPT SELECT * FROM h)
"""

ORACLES["p7_counters"] = """
WITH e AS (SELECT event_type, epoch_us(ts) // 300000000 AS b, max(epoch_us(ts)) AS us, count(*) AS n FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
r AS (SELECT event_type, us, sum(n) OVER (PARTITION BY event_type, b // 288 ORDER BY b) AS c FROM e),
i AS (SELECT event_type, us AS a, lead(us) OVER w AS z, CASE WHEN lead(c) OVER w >= c THEN lead(c) OVER w - c ELSE lead(c) OVER w END AS inc FROM r WINDOW w AS (PARTITION BY event_type ORDER BY us)),
g AS (SELECT *, unnest(generate_series(a // 3600000000, (z - 1) // 3600000000)) AS slot FROM i WHERE z IS NOT NULL),
o AS (SELECT *, least(z, (slot + 1) * 3600000000) - greatest(a, slot * 3600000000) AS o FROM g),
s AS (SELECT event_type, slot, sum(CASE WHEN z - a <= 7200000000 THEN o ELSE 0 END) / 1000000 AS covered_s, sum(inc * o / (z - a)) AS n_events FROM o GROUP BY 1, 2),
k AS (SELECT event_type, us // 3600000000 AS slot, count(*) AS n FROM r GROUP BY 1, 2)
SELECT coalesce(s.event_type, k.event_type) AS event_type, CAST(coalesce(s.slot, k.slot) * 3600 AS BIGINT) AS slot_s, CAST(coalesce(n, 0) AS BIGINT) AS n_readings, round(coalesce(covered_s, 0), 6) + 0.0 AS covered_s,
  CASE WHEN n > 0 THEN 'read' WHEN covered_s > 0 THEN 'filled' ELSE 'missing' END AS state, round(n_events, 5) + 0.0 AS n_events
FROM s FULL JOIN k ON s.event_type = k.event_type AND s.slot = k.slot
"""

ORACLES["p5_found"] = """
WITH v AS (
  SELECT pack_id, load_id, column_name, x, CAST(NULL AS VARCHAR) AS t FROM (
    SELECT pack_id, load_id, p_max_filter, effective_num_states_filter, expected_state_filter, p_margin_filter FROM rl_observation_pack)
    UNPIVOT INCLUDE NULLS (x FOR column_name IN (p_max_filter, effective_num_states_filter, expected_state_filter, p_margin_filter))
  UNION ALL SELECT pack_id, load_id, 'digest', NULL, digest FROM rl_observation_pack),
b AS (SELECT *, CASE column_name WHEN 'p_max_filter' THEN 0.333 WHEN 'effective_num_states_filter' THEN 1 ELSE 0 END AS lo,
             CASE column_name WHEN 'effective_num_states_filter' THEN 3 WHEN 'expected_state_filter' THEN 2 ELSE 1 END AS hi FROM v),
m AS (SELECT pack_id, load_id, column_name, avg(CAST(x IS NULL AND t IS NULL AS INT)) AS nulls, count(DISTINCT x) / nullif(count(x), 0) AS dist,
             count(*) FILTER (WHERE x IS NOT NULL AND NOT (x >= lo AND x <= hi)) AS n_out,
             count(*) FILTER (WHERE t IS NOT NULL AND NOT regexp_full_match(t, '[0-9a-f]{12}')) AS n_bad FROM b GROUP BY ALL),
u AS (SELECT a.pack_id, a.load_id, a.column_name, any_value(a.nulls) AS nulls, any_value(a.dist) AS dist, any_value(a.n_out) AS n_out, any_value(a.n_bad) AS n_bad,
             median(o.nulls) AS u_nulls, median(o.dist) AS u_dist
      FROM m a LEFT JOIN m o ON a.pack_id = o.pack_id AND a.column_name = o.column_name AND a.load_id <> o.load_id GROUP BY 1, 2, 3),
c AS (SELECT pack_id, load_id, column_name, x FROM b WHERE x >= lo AND x <= hi),
n AS (SELECT pack_id, load_id, column_name, count(*) AS n FROM c GROUP BY ALL),
q AS (SELECT pack_id, column_name, unnest(a) AS p FROM (SELECT pack_id, column_name, quantile_disc(x, [(i + 0.5) / 40 FOR i IN range(0, 40)]) AS a FROM c GROUP BY 1, 2)),
f AS (SELECT q.pack_id, q.column_name, q.p, c.load_id, count(*) FILTER (WHERE c.x <= q.p) / count(*) AS s
      FROM (SELECT DISTINCT * FROM q) q JOIN c USING (pack_id, column_name) GROUP BY ALL),
k AS (SELECT a.pack_id, a.column_name, a.load_id, a.p, avg(CAST(abs(a.s - o.s) > 0.25 AS INT)) AS far
      FROM f a JOIN f o ON a.pack_id = o.pack_id AND a.column_name = o.column_name AND a.p = o.p AND a.load_id <> o.load_id GROUP BY ALL),
sh AS (SELECT DISTINCT pack_id, column_name, load_id FROM k WHERE far > 0.5)
SELECT load_id, column_name, 'nulls' AS finding FROM u WHERE nulls > u_nulls + 0.10
UNION ALL SELECT load_id, column_name, 'range' FROM u WHERE n_out > 0 AND column_name <> 'digest'
UNION ALL SELECT load_id, column_name, 'distinct' FROM u WHERE dist < 0.5 * u_dist AND column_name <> 'digest'
UNION ALL SELECT load_id, column_name, 'pattern' FROM u WHERE n_bad > 0
UNION ALL SELECT load_id, column_name, 'shift' FROM sh
"""

ORACLES["p5_incremental"] = ORACLES["p5_found"]

_GAUGES = ("p_max_filter", "effective_num_states_filter", "expected_state_filter", "p_margin_filter")


def _gauge_sql(i: int, c: str) -> str:
    return f"""
a{i} AS (SELECT pack_id, segment, step, us, max_by({c}, obs_id) AS x FROM r WHERE {c} IS NOT NULL AND NOT isnan({c}) GROUP BY 1, 2, 3, 4),
b{i} AS (SELECT *, lead(us) OVER (PARTITION BY pack_id, segment, step ORDER BY us) AS z FROM a{i}),
c{i} AS (SELECT *, unnest(generate_series(us // step, (z - 1) // step)) AS slot FROM b{i} WHERE z IS NOT NULL AND z - us <= 2 * step),
y{i} AS (SELECT pack_id, segment, step, slot, sum(x * o) / sum(o) AS y FROM (SELECT *, least(z, (slot + 1) * step) - greatest(us, slot * step) AS o FROM c{i}) GROUP BY 1, 2, 3, 4)"""


_ON = " AND ".join(f"g.{k} = {{0}}.{k}" for k in ("pack_id", "segment", "step", "slot"))
ORACLES["p7_series"] = f"""
WITH r AS (SELECT *, CASE bar_step WHEN '30m' THEN 1800000000 WHEN '1h' THEN 3600000000 WHEN '4h' THEN 14400000000 WHEN '8h' THEN 28800000000 END AS step, epoch_us("timestamp") AS us
  FROM rl_observation_pack WHERE pack_id IS NOT NULL AND segment IS NOT NULL AND "timestamp" IS NOT NULL AND bar_step IS NOT NULL),
g AS (SELECT pack_id, segment, step, unnest(generate_series(min(us // step), max(us // step))) AS slot FROM r GROUP BY 1, 2, 3),
n AS (SELECT pack_id, segment, step, us // step AS slot, count(*) AS n FROM r GROUP BY 1, 2, 3, 4),
u AS (SELECT DISTINCT pack_id, segment, step, us FROM r), v AS (SELECT *, lead(us) OVER (PARTITION BY pack_id, segment, step ORDER BY us) AS z FROM u),
w AS (SELECT *, unnest(generate_series(us // step, (z - 1) // step)) AS slot FROM v WHERE z IS NOT NULL AND z - us <= 2 * step),
k AS (SELECT pack_id, segment, step, slot, sum(least(z, (slot + 1) * step) - greatest(us, slot * step)) / 1000000 AS c FROM w GROUP BY 1, 2, 3, 4),{','.join(_gauge_sql(i, c) for i, c in enumerate(_GAUGES))}
SELECT g.pack_id, g.segment, CAST(g.slot * g.step // 1000000 AS BIGINT) AS slot_s, CAST(coalesce(n, 0) AS BIGINT) AS n_readings, round(coalesce(c, 0), 6) + 0.0 AS covered_s,
  CASE WHEN n > 0 THEN 'read' WHEN c > 0 THEN 'filled' ELSE 'missing' END AS state, {', '.join(f'round(y{i}.y, 9) + 0.0 AS {c}' for i, c in enumerate(_GAUGES))}
FROM g LEFT JOIN n ON {_ON.format('n')} LEFT JOIN k ON {_ON.format('k')} {' '.join(f'LEFT JOIN y{i} ON ' + _ON.format(f'y{i}') for i in range(len(_GAUGES)))}
"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Close and volume readings that can't be right, measured by what is normal for their source."""
    return spikes.find_implausible(table(spark, d, "features"))


QUERIES["p3_found"] = p3_found


#: The unified funding record and the names its fields go by.
FUNDING_TARGETS = {
    "funding_rate": ("double", ("fundingrate", "rate", "funding")),
    "symbol": ("string", ("symbol",)),
    "event_time": ("string", ("fundingtimeutc", "fundingtime", "timestamp", "tsevent", "time")),
}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields added, removed, renamed or changed in type from one file of a stream to the next."""
    return schemas.schema_changes(table(spark, d, "funding_files"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """All files as one table of funding records."""
    files = table(spark, d, "funding_files")
    cells = as_table(schemas.record_cells(files), "cells")  # each payload is parsed once
    return schemas.unify(files, schemas.schema_changes(files, cells=cells), FUNDING_TARGETS, cells=cells)


QUERIES |= {"p4_found": p4_found, "p4_records": p4_records}
