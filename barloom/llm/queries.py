"""Queries of the operators in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import content, nearest, packing, quantiles, tokenizer
from barloom.session import as_table, cut_lineage
from barloom.sources.tables import table

_METRICS = ("sharpe", "max_dd")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of sharpe and max_dd per wf_id and fold, per fold and overall, from states of single days of logged_at."""
    runs = quantiles.once_per_run(table(spark, d, "run_walkforward").select("run_id", "row_id", "wf_id", "fold", "logged_at", *_METRICS), "run_id", "row_id", ["wf_id", "fold", "logged_at", *_METRICS])
    days = as_table(quantiles.day_states(runs, F.to_date("logged_at"), ["wf_id", "fold"], _METRICS), "days")  # kept, a later day's states join them
    groups = cut_lineage(quantiles.merge_states(days, ["wf_id", "fold"], _METRICS))
    none = F.lit(None)
    fine = quantiles.percentiles(groups, ["wf_id", "fold"], _METRICS).withColumn("level", F.lit("wf_id_fold"))
    folds = quantiles.percentiles(quantiles.merge_states(groups, ["fold"], _METRICS), ["fold"], _METRICS).withColumns({"level": F.lit("fold"), "wf_id": none.cast("string")})
    total = quantiles.percentiles(quantiles.merge_states(groups, [], _METRICS), [], _METRICS).withColumns({"level": F.lit("overall"), "wf_id": none.cast("string"), "fold": none.cast("int")})
    return fine.unionByName(folds).unionByName(total)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The nearest usable funding event of each row of train_v1_dataset within 30 minutes."""
    return _p6(spark, d).select("row_id", "funding_id")


def _p6(spark: SparkSession, d: str, keep: list[str] | None = None) -> DataFrame:
    return nearest.nearest_by_time(table(spark, d, "train_v1_dataset"), table(spark, d, "funding_8h"), ["venue", "symbol"], "row_id", "funding_id", values=["funding_rate_1h_scaled"], tolerance_s=1800, keep=keep)


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Each row of train_v1_dataset with its nearest funding event and that event's rate, null where none is within the tolerance."""
    return _p6(spark, d, ["venue", "symbol", "timestamp"])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of each document."""
    return tokenizer.token_ids(table(spark, d, "documents"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or of its pieces where it is longer than the capacity, for each kind of container."""
    sizes = cut_lineage(tokenizer.token_counts(table(spark, d, "documents")))
    items = cut_lineage(packing.pieces(sizes, table(spark, d, "containers")))
    most = items.groupBy("container_kind").count().agg(F.max("count")).first()[0] or 0
    return packing.pack(items, most, cut=cut_lineage)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, tokens placed and the share of room left, for each kind of container."""
    bins = p9_packed(spark, d).groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"), F.max("capacity_tokens").alias("capacity"))
    return bins.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), (1 - F.sum("used") / F.sum("capacity")).alias("room_share"))


def _p10(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    docs = table(spark, d, "documents")
    return content.score_documents(docs, content.fit(docs, table(spark, d, "content_labels")), keep=keep)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _p10(spark, d).where("flagged").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of each document."""
    return _p10(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of such documents for each source."""
    scored = _p10(spark, d, ("source",))
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p6_found, p6_nearest, p8_ids, p9_packed, p9_fill, p10_found, p10_scores, p10_rates)}

ORACLES: dict[str, str] = {}

ORACLES["p6_found"] = """
WITH l AS (SELECT row_id, venue, symbol, epoch_us("timestamp") AS t FROM train_v1_dataset WHERE venue IS NOT NULL AND symbol IS NOT NULL AND "timestamp" IS NOT NULL),
r AS (SELECT funding_id, venue, symbol, epoch_us("timestamp") AS t FROM funding_8h WHERE "timestamp" IS NOT NULL AND funding_rate_1h_scaled IS NOT NULL),
p AS (SELECT row_id, funding_id, row_number() OVER (PARTITION BY row_id ORDER BY abs(l.t - r.t), funding_id) AS k
      FROM l JOIN r ON l.venue = r.venue AND l.symbol = r.symbol AND r.t BETWEEN l.t - 1800000000 AND l.t + 1800000000)
SELECT row_id, funding_id FROM p WHERE k = 1
"""

ORACLES["p6_nearest"] = f"""
SELECT a.row_id, a.venue, a.symbol, a."timestamp", n.funding_id, abs(epoch_us(a."timestamp") - epoch_us(f."timestamp")) AS distance_us, f.funding_rate_1h_scaled
FROM train_v1_dataset a LEFT JOIN ({ORACLES["p6_found"]}) n ON a.row_id = n.row_id LEFT JOIN funding_8h f ON n.funding_id = f.funding_id
"""
