"""Isolation Forest as a distributed job, after Liu, Ting and Zhou (ICDM 2008).

The model is a table of tree nodes. Its size is set by the number of trees and the
sample per tree, never by the data, so it is checked once and broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchtrail.functions import constants as K
from watchtrail.functions.scoring import FeatureReader
from watchtrail.operators.features import numeric_matrix
from watchtrail.operators.ranking import percentile_by_group

TREE_SCHEMA = (
    "tree_id int, node_id int, feature int, threshold double, "
    "left int, right int, n_samples long"
)
ALGORITHM = "IsolationForest"
MAX_MODEL_NODES = 2_000_000
SCORING_ROWS = 128


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    mean = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, mean))


@dataclass(frozen=True)
class ForestModel:
    """Tree nodes plus the manifest that travels with them."""

    nodes: pd.DataFrame = field(repr=False)
    manifest: dict
    #: The packed nodes as broadcast, by application; models that differ in their manifest only share it.
    shared: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def features(self) -> list[str]:
        return list(self.manifest["feature_columns"])

    @property
    def threshold(self) -> float:
        return read_threshold(self.manifest)

    def trees(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, TREE_SCHEMA)

    def with_manifest(self, **entries) -> ForestModel:
        return ForestModel(self.nodes, {**self.manifest, **entries}, self.shared)

    def packed(self, spark: SparkSession):
        """The nodes, packed and sent to the executors once per application."""
        context = spark.sparkContext
        if context.applicationId not in self.shared:
            self.shared.clear()
            self.shared[context.applicationId] = context.broadcast(_pack(self.nodes))
        return self.shared[context.applicationId]

    def decision(self, spark: SparkSession, read: FeatureReader = F.col) -> Column:
        """Decision value per row: below 0 is the uncalibrated boundary."""
        packed = self.packed(spark)
        sample, offset = self.manifest["sample_size"], self.manifest["offset"]
        scale = float(average_path(sample)) or 1.0

        @F.pandas_udf("double")
        def decide(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest = packed.value
            for columns in batches:
                rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                depth = _mean_depth(forest, rows)
                yield pd.Series(offset - np.power(2.0, -depth / scale))

        return decide(*[read(name).cast("double") for name in self.features])


def _pack(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """Flatten all trees into arrays. Leaves point at themselves, so every walk has equal length."""
    if len(nodes) > MAX_MODEL_NODES:
        raise ValueError(f"The model has {len(nodes)} nodes; at most {MAX_MODEL_NODES} are broadcast.")
    ordered = nodes.sort_values(["tree_id", "node_id"], ignore_index=True)
    place = pd.Series(ordered.index, index=pd.MultiIndex.from_frame(ordered[["tree_id", "node_id"]]))
    here = np.arange(len(ordered))
    leaf = ordered["feature"].to_numpy() < 0

    def target(side: str) -> np.ndarray:
        wanted = pd.MultiIndex.from_arrays([ordered["tree_id"], ordered[side]])
        found = place.reindex(wanted).to_numpy()
        return np.where(leaf, here, np.nan_to_num(found, nan=-1)).astype(np.int64)

    left, right = target("left"), target("right")
    depth = np.zeros(len(ordered))
    roots = here[ordered["node_id"].to_numpy() == 0]
    level, front = 0, roots
    while len(front):
        depth[front] = level
        inner = front[~leaf[front]]
        front = np.concatenate([left[inner], right[inner]])
        level += 1
    value = np.where(leaf, depth + average_path(ordered["n_samples"]), 0.0)
    return {
        "feature": np.where(leaf, 0, ordered["feature"]).astype(np.int64),
        "threshold": np.where(leaf, np.inf, ordered["threshold"]).astype(float),
        "left": left,
        "right": right,
        "value": value,
        "roots": roots,
        "levels": np.array([level - 1]),
    }


def _mean_depth(forest: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Mean leaf value of each row over all trees; blocks are small enough to stay in the cache."""
    depth = np.empty(len(rows))
    width, trees = rows.shape[1], len(forest["roots"])
    feature, threshold, roots = forest["feature"].astype(np.int32), forest["threshold"], forest["roots"].astype(np.int32)
    # Children side by side: a step to the left is the odd place.
    child = np.column_stack([forest["right"], forest["left"]]).ravel().astype(np.int32)
    for start in range(0, len(rows), SCORING_ROWS):
        part = rows[start : start + SCORING_ROWS]
        values = part.ravel()
        line = (np.arange(len(part), dtype=np.int32) * width)[:, None]
        node = np.broadcast_to(roots, (len(part), trees))
        for _ in range(int(forest["levels"][0])):
            goes_left = values.take(line + feature.take(node)) <= threshold.take(node)
            node = child.take(2 * node + goes_left)
        depth[start : start + SCORING_ROWS] = forest["value"].take(node).mean(axis=1)
    return depth


def fit_forest(
    df: DataFrame,
    features: Sequence[str] = K.FEATURES,
    n_estimators: int = 300,
    contamination: float = 0.10,
    max_samples: int = 256,
    seed: int = 42,
    key: str = "event_id",
    label: str = K.TARGET,
    model_name: str = "isolation-forest",
    model_version: str = "0.1.0",
) -> ForestModel:
    """Grow the forest on normal rows only.

    ``key`` identifies a row, which makes the result independent of how rows are
    partitioned. Each tree draws its own sample from a uniform pool large enough for
    every tree to have had rows of its own, so at most ``n_estimators * max_samples`` rows
    are fitted, whatever the size of the table. Scoring broadcasts the nodes; parameters
    that could grow more than ``MAX_MODEL_NODES`` of them are refused.
    """
    spark = df.sparkSession
    if n_estimators * (2 * max_samples - 1) > MAX_MODEL_NODES:
        raise ValueError(f"n_estimators and max_samples allow more than {MAX_MODEL_NODES} nodes")
    normal = numeric_matrix(df.filter(F.col(label) == 0), features).select(
        F.xxhash64(F.lit(seed), F.col(key)).alias("_hash"), F.col(key).alias("_key"), *features
    )
    total = normal.count()
    if total == 0:
        raise ValueError("there are no normal rows to train on")
    sample_size = min(max_samples, total)
    pool_size = min(total, n_estimators * sample_size)
    pool = _uniform_pool(normal, total, pool_size)

    picks = _draws(spark, n_estimators, sample_size, pool_size, seed)
    grow = _grower(list(features), sample_size, seed)
    # The samples are small, so left alone they would be merged into a task or two.
    tasks = min(n_estimators, spark.sparkContext.defaultParallelism)
    samples = picks.join(pool, "_row").repartition(tasks, "tree_id")
    nodes = samples.groupBy("tree_id").applyInPandas(grow, TREE_SCHEMA).toPandas()
    manifest = {
        "model_name": model_name,
        "model_version": model_version,
        "algorithm": ALGORITHM,
        "feature_columns": list(features),
        "target_column": label,
        "normal_label": 0,
        "suspicious_label": 1,
        "sample_size": int(sample_size),
        "offset": 0.0,
        "normal_training_rows": int(total),
    }
    model = ForestModel(nodes, manifest)
    suspicion = normal.select((-model.decision(spark)).alias("_s"))
    shift = percentile_by_group(suspicion, "_s", 1.0 - contamination, out="offset", keep=True)
    return model.with_manifest(offset=float(shift.first()["offset"]))


def _uniform_pool(normal: DataFrame, total: int, size: int) -> DataFrame:
    """The ``size`` rows with the lowest key hash, numbered from 0.

    A cut on the hash first leaves little more than ``size`` rows, so the final ordering
    never sees the whole table.
    """
    pool = normal
    if total > size:
        share = min(1.0, (size + 8.0 * math.sqrt(size) + 16.0) / total)
        cut = int(-(2**63) + share * 2**64) if share < 1.0 else 2**63 - 1
        trimmed = normal.filter(F.col("_hash") <= F.lit(min(cut, 2**63 - 1)))
        pool = trimmed if trimmed.count() >= size else normal
    lowest = pool.orderBy("_hash", "_key").limit(size)
    number = F.row_number().over(Window.orderBy("_hash", "_key")) - 1
    return lowest.withColumn("_row", number)


def _draws(spark, n_estimators, sample_size, pool_size, seed) -> DataFrame:
    """(tree_id, pool row) pairs: each tree samples the pool without replacement."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                rows = rng.choice(pool_size, size=sample_size, replace=False)
                yield pd.DataFrame({"tree_id": int(tree), "_row": rows.astype("int32")})

    return spark.range(n_estimators).mapInPandas(draw, "tree_id int, _row int")


def _grower(features: list[str], sample_size: int, seed: int):
    limit = math.ceil(math.log2(max(sample_size, 2)))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree_id"].iloc[0])
        rng = np.random.default_rng([seed, tree, 1])
        rows = part.sort_values("_row")[features].to_numpy(dtype=float)
        table, pending = [], [(0, rows, 0)]
        issued = 1
        while pending:
            node, rows, depth = pending.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or len(usable) == 0:
                table.append((tree, node, -1, None, -1, -1, len(rows)))
                continue
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(low[feature], high[feature]))
            goes_left = rows[:, feature] <= cut
            left, right = issued, issued + 1
            issued += 2
            table.append((tree, node, feature, cut, left, right, len(rows)))
            pending += [(right, rows[~goes_left], depth + 1), (left, rows[goes_left], depth + 1)]
        return pd.DataFrame(
            table,
            columns=["tree_id", "node_id", "feature", "threshold", "left", "right", "n_samples"],
        )

    return grow


def read_threshold(manifest: dict, name: str = K.DEFAULT_THRESHOLD_KEY) -> float:
    """The calibrated cutoff; there is no fallback to an uncalibrated one."""
    if name not in manifest:
        raise ValueError(f"The model manifest has no '{name}'; calibrate the model first.")
    try:
        value = float(manifest[name])
    except (TypeError, ValueError) as error:
        raise ValueError(f"'{name}' must be numeric, not {manifest[name]!r}.") from error
    if not math.isfinite(value):
        raise ValueError(f"'{name}' must be finite, not {manifest[name]!r}.")
    return value


def validate_model(model: ForestModel) -> None:
    """Refuse a model whose tables do not fit together; then score one zero row."""
    manifest, nodes = model.manifest, model.nodes
    if not isinstance(manifest, dict):
        raise ValueError("The model manifest must be an object.")
    if not manifest.get("feature_columns") or not manifest.get("algorithm"):
        raise ValueError("The model manifest lacks feature_columns or algorithm.")
    if manifest["algorithm"] != ALGORITHM:
        raise TypeError(f"The model is not an {ALGORITHM}.")
    if len(nodes) == 0:
        raise ValueError("The model has no trees.")
    inner = nodes[nodes["feature"] >= 0]
    if (inner["feature"] >= len(manifest["feature_columns"])).any():
        raise ValueError("A tree tests a feature the manifest does not list.")
    known = set(zip(nodes["tree_id"], nodes["node_id"], strict=True))
    for side in ("left", "right"):
        if not set(zip(inner["tree_id"], inner[side], strict=True)) <= known:
            raise ValueError("A tree node names a child that does not exist.")
    zero = np.zeros((1, len(manifest["feature_columns"])))
    if not np.isfinite(_mean_depth(_pack(nodes), zero)).all():
        raise ValueError("The model cannot score a zero row.")
