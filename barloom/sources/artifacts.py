"""Files around the tables: readers by suffix, JSON contracts, sinks, run registry and dataset directories."""

from __future__ import annotations

import hashlib
import json
import math
import os
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the run registry.
REGISTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("run_id", "timestamp_utc", "seed", "score_val", "score_oos", "sharpe_oos", "maxdd_oos", "turnover_oos", "funding_mode")])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet, csv or json table by its suffix; header names of csv files are trimmed. A single .json file is one document, a folder
    of that name and .jsonl files have one document a line."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        df = (reader if schema else reader.option("inferSchema", True)).option("header", True).csv(path)
        return df.toDF(*[c.strip() for c in df.columns])
    if kind in ("json", "jsonl"):
        fs, at = _hadoop(spark, path)
        return reader.option("multiLine", kind == "json" and not fs.getFileStatus(at).isDirectory()).json(path)
    raise ValueError(f"no reader for {path}")


def write_table(df: DataFrame, path: str, mode: str = "error") -> str:
    """df as parquet or csv by the path's suffix; the path."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"no writer for {path}")
    w = df.write.mode(mode)
    (w.option("header", True).csv if kind == "csv" else getattr(w, kind))(path)
    return path


def append_run(spark: SparkSession, path: str, row: Mapping[str, object]) -> None:
    """Append a run to the registry: unknown keys are ignored, null and NaN are empty, floats have ten significant digits."""

    def text(v: object) -> str:
        if v is None or (isinstance(v, float) and v != v):
            return ""
        return f"{v:.10g}" if isinstance(v, float) else str(v)

    spark.createDataFrame([tuple(text(row.get(f.name)) for f in REGISTRY)], REGISTRY).coalesce(1).write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def default_path(folder: str | None = None, names: Sequence[str] = ("dataset.parquet", "ohlcv.parquet", "ohlcv.csv")) -> str:
    """The dataset to read when none is named: BARLOOM_DATA where it is set, else the first of `names` in folder; raises if none is there."""
    if wanted := os.environ.get("BARLOOM_DATA"):
        return wanted
    for n in names:
        if folder and os.path.exists(os.path.join(folder, n)):
            return os.path.join(folder, n)
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}; set BARLOOM_DATA or name a path")


def plain_json(value: object) -> object:
    """value in JSON's own types: paths and other objects as texts, sets sorted, times in ISO 8601, NumPy numbers as numbers, NaN and
    infinite numbers as null."""
    if isinstance(value, Mapping):
        return {str(k): plain_json(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((plain_json(v) for v in value), key=repr)
    if isinstance(value, (list, tuple)):
        return [plain_json(v) for v in value]
    if hasattr(value, "tolist"):
        return plain_json(value.tolist())
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(path: str, spark: SparkSession | None = None) -> bool:
    if spark is None:
        return os.path.exists(path)
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def write_json(path: str, value: Mapping[str, object], merge: bool = False, spark: SparkSession | None = None) -> None:
    """value as a JSON file; merge keeps the other keys of the file that is there. With spark, on any file system that it knows."""
    known = read_json(path, spark) if merge and exists(path, spark) else {}
    text = json.dumps({**known, **plain_json(value)}, indent=1, sort_keys=True).encode("utf-8")
    if spark is None:
        Path(path).write_bytes(text)
        return
    fs, at = _hadoop(spark, path)
    out = fs.create(at, True)
    out.write(text)
    out.close()


def run_manifest(spark: SparkSession, inputs: Mapping[str, DataFrame], settings: Mapping[str, object]) -> dict:
    """What a run read and how: rows and content digest of each input, settings, versions and time."""
    from barloom.operators.audit import digest

    read = {n: digest(df).first().asDict() for n, df in inputs.items()}
    return plain_json({"created_utc": datetime.now(timezone.utc), "inputs": read, "settings": settings, "spark": spark.version, "python": sys.version.split()[0], "session_timezone": spark.conf.get("spark.sql.session.timeZone")})


@dataclass(frozen=True)
class RegimePack:
    """A checked regime pack: its rows, contract, manifest, quality summary (or None) and the hash of its data file (None for a folder)."""

    rows: DataFrame
    contract: dict
    manifest: dict
    quality: dict | None
    digest: str | None


def read_regime_pack(spark: SparkSession, folder: str, strict: bool = True) -> RegimePack:
    """The pack in a directory of rl_observation_pack.parquet, feature_contract.json, manifest.json and maybe quality_summary.json.

    Rows without a readable time and repeated times of a pack and segment raise if strict, else they are dropped, of repeated ones all but
    that with the smallest values. Columns that the contract forbids raise, and a hash that the manifest gives (`sha256`) must be
    the file's."""
    at = os.path.join(folder, "rl_observation_pack.parquet")
    contract, manifest = read_json(os.path.join(folder, "feature_contract.json"), spark), read_json(os.path.join(folder, "manifest.json"), spark)
    quality = os.path.join(folder, "quality_summary.json")
    rows = spark.read.parquet(at)
    kind = dict(rows.dtypes)["timestamp"]
    rows = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp") if kind.startswith(("timestamp", "date")) else F.col("timestamp").try_cast("timestamp"))
    if bad := sorted(set(contract.get("forbidden_columns_v1", ())) & set(rows.columns)):
        raise ValueError(f"forbidden columns: {bad}")
    own = sha256(at) if os.path.isfile(at) else None
    if own and manifest.get("sha256") not in (None, own):
        raise ValueError(f"{at} isn't the file of its manifest")
    keys = [k for k in ("pack_id", "segment", "timestamp") if k in rows.columns]
    rest = [c for c in rows.columns if c not in keys]
    good = rows.where(F.col("timestamp").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row"))
    if strict:
        lost = rows.where(F.col("timestamp").isNull()).count()
        twice = good.where("_n > 1").count()
        if lost or twice:
            raise ValueError(f"{lost} rows without a time, {twice} repeated times")
    return RegimePack(good.select(*keys, "_row.*").select(*rows.columns), contract, manifest, read_json(quality, spark) if exists(quality, spark) else None, own)


def read_json(path: str, spark: SparkSession | None = None) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0] if spark else Path(path).read_text(encoding="utf-8"))


def sha256(path: str, block: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(block):
            digest.update(chunk)
    return digest.hexdigest()


def latest_dataset(root: str, needed: tuple[str, ...], wanted: str | None = None) -> Path:
    """The directory `wanted` below root, or else the newest one that holds all needed files; raises when there is none."""
    found = [p for p in Path(root).iterdir() if p.is_dir() and all((p / n).exists() for n in needed) and wanted in (None, p.name)]
    if not found:
        raise FileNotFoundError(f"no dataset {wanted or ''} with {', '.join(needed)} in {root}")
    return max(found, key=lambda p: (os.path.getmtime(p), p.name))


def flat_metrics(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """A flat row of metrics from nested JSON: output name to dotted path, 0 where a path is missing or no number."""
    known = set()

    def walk(t: T.StructType, at: str) -> None:
        for f in t.fields:
            known.add(at + f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, f"{at}{f.name}.")

    walk(df.schema, "")
    return df.select(*[(F.coalesce(F.col(p).cast("string").try_cast("double"), F.lit(0.0)) if p in known else F.lit(0.0)).alias(n) for n, p in fields.items()])
