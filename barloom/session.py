"""Spark session and shared-storage helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "barloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE and skew-join handling."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a session on one machine may leave it unset and gets a
    temporary one; on a cluster that raises."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
        known = tempfile.mkdtemp(prefix="barloom-shared-")
        atexit.register(shutil.rmtree, known, True)
        spark.conf.set("spark.checkpoint.dir", known)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(known)
    return known


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and go on from there; it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_table(df: DataFrame, name: str) -> DataFrame:
    """df written as a parquet table in the shared folder and read again, for results that several plans read by column. The table
    is removed when the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows, counted up to that bound; else df as it is, for a shuffled join
    (whose skewed keys AQE splits). For lookup tables of few narrow columns."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
