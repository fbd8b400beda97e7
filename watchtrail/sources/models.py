"""Model storage: node table, manifest and metrics as plain tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtrail.operators.forest import MAX_MODEL_NODES, TREE_SCHEMA, ForestModel

METRIC_NAMES = {
    "precision": "precision",
    "recall": "recall",
    "f1": "f1_score",
    "roc_auc": "roc_auc",
    "pr_auc": "pr_auc",
}


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def current_version(spark: SparkSession, path: str) -> int | None:
    """The newest published version under ``path``; None when none was published."""
    fs, folder = _files(spark, f"{path}/published")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = [int(n.split(".")[0]) for n in names if n.endswith(".json")]
    return max(found) if found else None


def save_model(spark: SparkSession, model: ForestModel, path: str, metrics: DataFrame | None = None) -> int:
    """Write nodes, manifest (with provenance counts) and metrics as a new version under ``path``.

    The parts go to a directory of their own; a pointer file is created after them and never
    overwritten, so a reader sees the previous version until the new one is whole, and two
    writers cannot publish the same version. Returns the version published.
    """
    version = (current_version(spark, path) or 0) + 1
    target = f"{path}/versions/{version:012d}"
    model.trees(spark).coalesce(1).write.mode("overwrite").parquet(f"{target}/trees")
    manifest = spark.range(1).select(F.lit(json.dumps(model.manifest)).alias("value"))
    manifest.coalesce(1).write.mode("overwrite").text(f"{target}/manifest")
    if metrics is not None:
        metrics.coalesce(1).write.mode("overwrite").json(f"{target}/metrics")
    fs, pointer = _files(spark, f"{path}/published/{version:012d}.json")
    stream = fs.create(pointer, False)
    try:
        stream.write(bytearray(json.dumps({"version": version}).encode()))
    finally:
        stream.close()
    return version


def model_folder(spark: SparkSession, path: str) -> str:
    """Where the newest published version lives; a store saved before versions is read as is."""
    version = current_version(spark, path)
    return path if version is None else f"{path}/versions/{version:012d}"


def load_model(spark: SparkSession, path: str) -> ForestModel:
    """Read the newest published model; its parts are type-checked and the node count is bounded."""
    path = model_folder(spark, path)
    text = spark.read.text(f"{path}/manifest", wholetext=True).first()
    manifest = json.loads(text["value"]) if text else None
    if not isinstance(manifest, dict) or not isinstance(manifest.get("feature_columns"), list):
        raise ValueError("The model manifest has no valid feature_columns list.")
    if manifest.get("algorithm") != "IsolationForest":
        raise TypeError("The stored model is not an IsolationForest.")
    trees = spark.read.schema(TREE_SCHEMA).parquet(f"{path}/trees")
    nodes = trees.limit(MAX_MODEL_NODES + 1).toPandas()
    if len(nodes) > MAX_MODEL_NODES:
        raise ValueError(f"The model has more than {MAX_MODEL_NODES} nodes.")
    return ForestModel(nodes, manifest)


def evaluation_document(metrics: DataFrame) -> DataFrame:
    """The evaluation report as one JSON text: nested ``metrics`` and a flat copy."""
    nested = F.struct(
        *[F.struct(F.col(c).alias("value")).alias(n) for n, c in METRIC_NAMES.items()]
    )
    flat = F.struct(*[F.col(c).alias(n) for n, c in METRIC_NAMES.items()])
    report = F.struct(
        "anomaly_threshold", nested.alias("metrics"), flat.alias("classification_metrics")
    )
    return metrics.select(F.to_json(report).alias("value"))


def write_evaluation(metrics: DataFrame, path: str) -> None:
    evaluation_document(metrics).coalesce(1).write.mode("overwrite").text(path)


def latest_model(registry: DataFrame, group: str | None = None, status: str | None = None) -> DataFrame:
    """Newest registered model of each group, or of one group, where the lookup must succeed."""
    chosen = registry if status is None else registry.filter(F.col("status") == status)
    if group is not None:
        chosen = chosen.filter(F.col("model_group") == group)
    others = [c for c in registry.columns if c != "model_group"]
    newest = chosen.groupBy("model_group").agg(
        F.max_by(F.struct(*others), F.struct("created_at", "version")).alias("_m")
    )
    found = newest.select("model_group", "_m.*")
    if group is not None and found.isEmpty():
        raise ValueError(f"No {status or 'registered'} model found in {group}.")
    return found
