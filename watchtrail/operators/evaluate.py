"""Splitting, calibrating and measuring a model with exact, distributed statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchtrail.functions import constants as K
from watchtrail.functions.values import fixed_text
from watchtrail.operators.ranking import join_same_keys, quantile_buckets, running_totals
from watchtrail.session import checkpoint_dir

HASH_BITS = 16
HASH_LEVELS = 2
#: Strata whose last rows are sent to all tasks; with more, the rows are shuffled to them.
MAX_SENT_STRATA = 10_000


# --- hold-out split ----------------------------------------------------------------


def stratified_split(
    df: DataFrame, share: float = 0.20, seed: int = 42, label: str = K.TARGET, key: str = "event_id"
) -> tuple[DataFrame, DataFrame]:
    """(fitting rows, held-out rows); the held-out count per label is exact.

    Each label holds out its own share, rounded half up, so with several labels the total
    can differ by a row per label from a share of the whole table. With one label, or a
    label of one row, the whole table is one stratum.

    Rows are ordered by a hash of their key. Only the row at which each label reaches its
    share has to be found; every row is then compared with its label's last held-out row.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    sizes = df.groupBy(label).count().agg(F.count("*").alias("labels"), F.min("count").alias("least")).first()
    stratified = sizes["labels"] > 1 and sizes["least"] >= 2
    placed = df.withColumns({"_stratum": F.col(label) if stratified else F.lit(0), "_order": order})
    last = _last_held_out(placed.select("_stratum", "_order", F.col(key).alias("_key")), share)
    if sizes["labels"] <= MAX_SENT_STRATA:
        # Shuffled by a few labels, the whole table would pass through as many tasks.
        last = F.broadcast(last)
    joined = join_same_keys(placed, last, ["_stratum"])
    before = F.col("_order") < F.col("_last")
    held = before | ((F.col("_order") == F.col("_last")) & (F.col(key) <= F.col("_last_key")))
    marked = joined.withColumn("_held", F.coalesce(held, F.lit(False)))
    added = ("_stratum", "_order", "_last", "_last_key", "_held")
    return marked.filter(~F.col("_held")).drop(*added), marked.filter("_held").drop(*added)


def _last_held_out(rows: DataFrame, share: float) -> DataFrame:
    """(_stratum, _last, _last_key): the row of each stratum that completes its share.

    The hash is narrowed down by ``HASH_BITS`` at a time, so that no task ever orders more
    than the rows of one narrow range of hashes, or the ranges of one stratum.
    """
    checkpoint_dir(rows.sparkSession)
    wanted = rows.groupBy("_stratum").agg(F.floor(F.count("*") * share + 0.5).alias("_left"))
    near, edge = rows, wanted.filter("_left > 0")
    along = Window.partitionBy("_stratum").orderBy("_range")
    for level in range(1, HASH_LEVELS + 1):
        ranges = near.withColumn("_range", F.shiftright("_order", 64 - HASH_BITS * level))
        counts = ranges.groupBy("_stratum", "_range").count()
        through = counts.withColumn("_through", F.sum("count").over(along))
        reached = join_same_keys(through, edge.select("_stratum", "_left"), ["_stratum"])
        crossed = (F.col("_through") >= F.col("_left")) & (F.col("_through") - F.col("count") < F.col("_left"))
        left = F.col("_left") - F.col("_through") + F.col("count")
        # One row per stratum.
        edge = reached.filter(crossed).select("_stratum", "_range", left.alias("_left")).checkpoint()
        near = join_same_keys(ranges, edge, ["_stratum", "_range"]).filter(F.col("_left").isNotNull())
        near = near.select("_stratum", "_order", "_key")
    number = F.row_number().over(Window.partitionBy("_stratum").orderBy("_order", "_key"))
    numbered = join_same_keys(near.withColumn("_n", number), edge.select("_stratum", "_left"), ["_stratum"])
    last = numbered.filter(F.col("_n") == F.col("_left"))
    return last.select("_stratum", F.col("_order").alias("_last"), F.col("_key").alias("_last_key"))


# --- curve statistics --------------------------------------------------------------


def score_curve(df: DataFrame, score: str, label: str = K.TARGET, keep: bool = False) -> DataFrame:
    """One row per distinct score with the rows and positives at or above it.

    ``keep`` checkpoints the per-score counts, for scores that are costly to compute.
    """
    counted = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count("*").alias("rows"), F.sum(F.col(label).cast("long")).alias("hits")
    )
    if keep:
        checkpoint_dir(df.sparkSession)
        counted = counted.checkpoint()
    ranked = running_totals(
        quantile_buckets(counted, "score", "_bucket"),
        F.col("score"),
        "_bucket",
        ["rows", "hits"],
        descending=True,
        grand=True,
    )
    return ranked.drop("_bucket").withColumnsRenamed({"all_running_rows": "all_rows", "all_running_hits": "all_hits"})


def calibrate_threshold(
    df: DataFrame, score: str = "suspicion", label: str = K.TARGET, curve: DataFrame | None = None
) -> DataFrame:
    """One row: the cutoff with the best F1; the lowest such score on ties."""
    curve = score_curve(df, score, label) if curve is None else curve
    precision = F.col("running_hits") / F.col("running_rows")
    recall = F.col("running_hits") / F.col("all_hits")
    one_class = (F.col("all_hits") == 0) | (F.col("all_hits") == F.col("all_rows"))
    message = "cannot choose a cutoff: the rows hold only one class"
    f1 = F.when(one_class, F.raise_error(F.lit(message)).cast("double")).otherwise(
        2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    )
    rated = curve.select("score", f1.alias("f1"))
    best = F.max_by("score", F.struct(F.col("f1"), -F.col("score")))
    return rated.agg(best.alias("threshold"), F.max("f1").alias("f1_score"))


def roc_auc(df: DataFrame, score: str, label: str = K.TARGET, curve: DataFrame | None = None) -> DataFrame:
    """One row: rank statistic with ties counted half."""
    curve = score_curve(df, score, label) if curve is None else curve
    misses = F.col("rows") - F.col("hits")
    won = misses * (F.col("running_hits") - F.col("hits") + F.col("hits") / 2.0)
    pairs = F.max("all_hits") * (F.max("all_rows") - F.max("all_hits"))
    return curve.agg(F.try_divide(F.sum(won), pairs.cast("double")).alias("roc_auc"))


def average_precision(
    df: DataFrame, score: str, label: str = K.TARGET, curve: DataFrame | None = None
) -> DataFrame:
    """One row: precision summed over the steps in recall."""
    curve = score_curve(df, score, label) if curve is None else curve
    step = F.try_divide(F.col("hits"), F.col("all_hits")) * (
        F.col("running_hits") / F.col("running_rows")
    )
    return curve.agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("pr_auc"))


# --- threshold metrics -------------------------------------------------------------


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _confusion(predicted: Column, actual: Column) -> list[Column]:
    def count(p: int, a: int) -> Column:
        hit = (predicted.cast("int") == p) & (actual.cast("int") == a)
        return F.count(F.when(hit, 1))

    return [
        count(0, 0).alias("true_negatives"),
        count(1, 0).alias("false_positives"),
        count(0, 1).alias("false_negatives"),
        count(1, 1).alias("true_positives"),
    ]


def _rates() -> dict[str, Column]:
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def classification_metrics(
    df: DataFrame, score: str, threshold: float | Column, label: str = K.TARGET
) -> DataFrame:
    """One row of counts and rates at a cutoff in suspicion space."""
    predicted = F.col(score) >= threshold
    counted = df.agg(
        F.count("*").alias("testing_rows"),
        F.count(F.when(predicted, 1)).alias("flagged_rows"),
        *_confusion(predicted, F.col(label)),
    )
    return counted.withColumns(_rates())


def contamination_baseline(df: DataFrame, decision: str, label: str = K.TARGET) -> DataFrame:
    """Metrics at the uncalibrated boundary, for comparison with the calibrated cutoff."""
    flagged = df.withColumn("_suspicion", (F.col(decision) < 0).cast("int"))
    return classification_metrics(flagged, "_suspicion", 1, label)


def evaluate_model(
    df: DataFrame, score: str, threshold: float, label: str = K.TARGET, keep: bool = False
) -> DataFrame:
    """One row with every metric of the promotion report, all taken from one curve."""
    curve = score_curve(df, score, label, keep)
    flagged = F.col("score") >= threshold
    at_cutoff = curve.agg(
        F.sum("rows").alias("testing_rows"),
        F.sum(F.when(flagged, F.col("rows")).otherwise(0)).alias("flagged_rows"),
        F.sum(F.when(~flagged, F.col("rows") - F.col("hits")).otherwise(0)).alias("true_negatives"),
        F.sum(F.when(flagged, F.col("rows") - F.col("hits")).otherwise(0)).alias("false_positives"),
        F.sum(F.when(~flagged, F.col("hits")).otherwise(0)).alias("false_negatives"),
        F.sum(F.when(flagged, F.col("hits")).otherwise(0)).alias("true_positives"),
    )
    return at_cutoff.withColumns(
        {
            "anomaly_threshold": F.lit(float(threshold)),
            **_rates(),
            "roc_auc": roc_auc(df, score, label, curve).scalar(),
            "pr_auc": average_precision(df, score, label, curve).scalar(),
        }
    )


def risk_level_metrics(predictions: DataFrame, label: str = K.TARGET) -> DataFrame:
    """Second evaluation: MEDIUM and HIGH count as positive; unlabelled rows are left out."""
    labelled = predictions.filter(F.col(label).isNotNull())
    positive = F.col("risk_level").isin("MEDIUM", "HIGH")
    counted = labelled.agg(*_confusion(positive, F.col(label)))
    return counted.select(
        *[F.round(value, 4).alias(name) for name, value in _rates().items()], *counted.columns
    )


def evaluate_gates(metrics: DataFrame, gates: dict[str, float] | None = None) -> DataFrame:
    """One row per gate, in display order, with its line of text and the overall verdict."""
    gates = K.QUALITY_GATES if gates is None else gates
    present = set(metrics.columns)

    def entry(place: int, name: str, required: float) -> Column:
        value = F.col(name).cast("double") if name in present else F.lit(None).cast("double")
        return F.struct(
            F.lit(place).alias("position"),
            F.lit(name).alias("metric"),
            F.coalesce(value, F.lit(0.0)).alias("value"),
            F.lit(required).alias("required"),
        )

    rows = F.array(*[entry(i, *gate) for i, gate in enumerate(gates.items(), start=1)])
    verdict = metrics.select(F.inline(rows)).withColumn("passed", F.col("value") >= F.col("required"))
    line = F.format_string(
        "%-10s %s (required >= %s) %s",
        F.col("metric"),
        fixed_text(F.col("value"), 4),
        fixed_text(F.col("required"), 2),
        F.when(F.col("passed"), "PASS").otherwise("FAIL"),
    )
    # Three gates per report: the window below never holds more rows than there are gates.
    return verdict.withColumns({"line": line, "all_passed": F.bool_and("passed").over(Window.partitionBy())})


# --- training pipeline -------------------------------------------------------------


def train(df: DataFrame, spark: SparkSession | None = None, key: str = "event_id", **options):
    """Split, fit on normal rows, calibrate on the held-out rows; returns the model."""
    from watchtrail.operators.forest import fit_forest

    spark = spark or df.sparkSession
    fitting, calibration = stratified_split(df, key=key)
    model = fit_forest(fitting, key=key, **options)
    rated = calibration.select(
        (-model.decision(spark)).alias("suspicion"), F.col(K.TARGET).cast("int").alias(K.TARGET)
    )
    curve = score_curve(rated, "suspicion", keep=True)
    best = calibrate_threshold(rated, curve=curve).first()
    rows = curve.agg(F.sum("rows")).first()[0]
    return model.with_manifest(
        anomaly_threshold=float(best["threshold"]), calibration_rows=int(rows)
    )
