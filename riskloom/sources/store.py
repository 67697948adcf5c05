"""A store of feature blocks: Parquet plus a manifest that is written last and checked on every load; other artifacts.

Blocks and manifests are read and written by Spark, so a root can be any place that Spark reaches. Each save writes a
new data folder; the manifest that names it comes last, so readers see the old block or the new one.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.aggregation import safe_name


class StoreError(ValueError):
    """A block is not what its manifest says, or must not be written."""


def block_paths(root: str, name: str) -> tuple[str, str]:
    """The folder of a block's data and its manifest."""
    return f"{root}/{name}", f"{root}/{name}.manifest"


def _key_counts(df: DataFrame, key: str) -> tuple[int, int, int]:
    """rows, missing keys, repeated keys."""
    g = df.groupBy(key).agg(F.count("*").alias("n"))
    row = g.agg(F.sum("n"), F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(0)), F.sum(F.when(F.col(key).isNotNull(), F.col("n") - 1).otherwise(0))).first()
    return tuple(int(x or 0) for x in row)


def save_block(df: DataFrame, name: str, root: str, builder_version: str, families: dict[str, str], key: str = "SK_ID_CURR") -> dict[str, Any]:
    """Check, write, and only then write the manifest."""
    features = [c for c in df.columns if c != key]
    faults = [
        (not builder_version, "no builder version"),
        (key not in df.columns, f"no column {key}"),
        (len({c.lower() for c in df.columns}) < len(df.columns), "repeated columns"),
        (any(safe_name(c) != c for c in df.columns), "unsafe column names"),
        (set(features) != set(families), f"families don't match the features: {sorted(set(features) ^ set(families))}"),
    ]
    for bad, text in faults:
        if bad:
            raise StoreError(f"{name}: {text}")
    folder, manifest = block_paths(root, name)
    rows, missing, repeated = _key_counts(df, key)
    if missing or repeated:
        raise StoreError(f"{name}: {missing} missing and {repeated} repeated keys")
    data = f"{folder}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(data)
    said = {"name": name, "data": data, "builder_version": builder_version, "key": key, "columns": df.columns, "types": dict(df.dtypes), "families": families, "rows": rows, "created": datetime.now(UTC).isoformat()}
    df.sparkSession.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    return said


def manifests(spark: SparkSession, root: str, name: str = "*") -> dict[str, dict[str, Any]]:
    """The manifests in a root, by block."""
    try:
        lines = spark.read.text(block_paths(root, name)[1]).collect()
    except AnalysisException:
        return {}
    return {m["name"]: m for m in (json.loads(r.value) for r in lines)}


def load_block(spark: SparkSession, name: str, root: str, builder_version: str | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """The block and its manifest; another version, other columns, another row count or a repeated key raises."""
    said = manifests(spark, root, name).get(name)
    if said is None:
        raise StoreError(f"{name}: no manifest in {root}")
    if builder_version is not None and said["builder_version"] != builder_version:
        raise StoreError(f"{name}: built by {said['builder_version']}, wanted {builder_version}")
    df = spark.read.parquet(said["data"])
    if df.columns != said["columns"]:
        raise StoreError(f"{name}: columns differ from the manifest: {sorted(set(df.columns) ^ set(said['columns']))}")
    rows, missing, repeated = _key_counts(df, said["key"])
    if rows != said["rows"] or missing or repeated:
        raise StoreError(f"{name}: {rows} rows for {said['rows']}, {missing} missing and {repeated} repeated keys")
    return df, said


def list_blocks(spark: SparkSession, root: str) -> list[str]:
    return sorted(manifests(spark, root))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(payload: Any, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, default=str))


def export_model(model: Any, path: str) -> None:
    """A Spark ML model in Spark's own format."""
    model.write().overwrite().save(path)


def submission(predictions: DataFrame, path: str, key: str = "SK_ID_CURR", score: str = "TARGET") -> None:
    """Two columns as CSV; missing or repeated keys and scores outside 0..1 raise."""
    _, missing, repeated = _key_counts(predictions, key)
    x = F.col(score)
    bad = predictions.where(x.isNull() | F.isnan(x) | (x < 0) | (x > 1)).limit(1).count()
    if missing or repeated or bad:
        raise StoreError(f"{missing} missing and {repeated} repeated keys, {bad and 'some'} invalid scores")
    export_csv(predictions.select(key, score), path)
