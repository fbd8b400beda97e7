"""Summaries, breakdowns and operational metrics over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtrail.functions.constants import TARGET
from watchtrail.operators.evaluate import risk_level_metrics
from watchtrail.operators.ranking import join_same_keys, percentile_by_group

PERIOD = "5 minutes"
RECENT_COLUMNS = (
    "timestamp", "event_name", "principal_id", "service", "risk_level", "final_risk_score",
)
MAX_QUEUE_AGE_SECONDS = 300


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


# --- views -------------------------------------------------------------------------


def filter_risk(df: DataFrame, level: str = "All") -> DataFrame:
    return df if level == "All" else df.filter(F.col("risk_level") == level)


def incidents_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("risk_level").isin("MEDIUM", "HIGH"))


def recent_rows(df: DataFrame, n: int = 100, level: str = "All") -> DataFrame:
    """The first ``n`` rows by time, then event id."""
    chosen = filter_risk(df, level).orderBy("timestamp", "event_id").limit(n)
    return chosen.select(*RECENT_COLUMNS)


def incident_detail(df: DataFrame, event_id: str) -> DataFrame:
    """One incident's fields; a missing attack type reads N/A. Text reasons are opened."""
    kind = dict(df.dtypes)["reasons"]
    reasons = F.from_json("reasons", "array<string>") if kind == "string" else F.col("reasons")
    attack = F.col("attack_type") if "attack_type" in df.columns else F.lit(None).cast("string")
    return df.filter(F.col("event_id") == event_id).select(
        "event_id",
        "timestamp",
        "event_name",
        "service",
        "principal_id",
        F.coalesce(attack, F.lit("N/A")).alias("attack_type"),
        "final_risk_score",
        "risk_level",
        reasons.alias("reasons"),
    )


# --- one-row summaries -------------------------------------------------------------


def batch_summary(predictions: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    return predictions.agg(
        F.count("*").alias("total_events"),
        _count_if(level == "LOW").alias("low_risk_events"),
        _count_if(level == "MEDIUM").alias("medium_risk_events"),
        _count_if(level == "HIGH").alias("high_risk_events"),
        _count_if(F.col("model_flagged_anomaly")).alias("ml_flagged_anomalies"),
        F.round(F.avg("anomaly_score"), 4).alias("average_anomaly_score"),
        F.round(F.avg("final_risk_score"), 4).alias("average_final_risk_score"),
    )


def summary_document(predictions: DataFrame) -> DataFrame:
    """The summary as one JSON text, with the evaluation when labels are present."""
    summary = batch_summary(predictions)
    parts = [F.col(name) for name in summary.columns]
    if TARGET in predictions.columns:
        rates = risk_level_metrics(predictions)
        matrix = F.array(
            F.array("true_negatives", "false_positives"), F.array("false_negatives", "true_positives")
        )
        evaluation = rates.select(
            F.when(
                F.col("true_negatives") + F.col("false_positives") + F.col("false_negatives")
                + F.col("true_positives") > 0,
                F.struct("precision", "recall", "f1_score", matrix.alias("confusion_matrix")),
            )
        )
        summary = summary.withColumn("evaluation", evaluation.scalar())
        parts.append(F.col("evaluation"))
    return summary.select(F.to_json(F.struct(*parts)).alias("summary"))


def kpis(predictions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Headline numbers; ``metrics`` is the one-row evaluation of the model."""
    counted = predictions.agg(
        F.count("*").alias("total_events"),
        _count_if(F.col("model_prediction") == "suspicious").alias("suspicious_predictions"),
        _count_if(F.col("risk_level") == "HIGH").alias("high_risk_incidents"),
    )
    recall = metrics.select(F.round(F.col("recall") * 100, 1)).scalar()
    return counted.withColumn("recall_percent", F.coalesce(recall, F.lit(0.0)))


# --- breakdowns --------------------------------------------------------------------


def risk_distribution(predictions: DataFrame) -> DataFrame:
    counted = predictions.groupBy("risk_level").agg(F.count("*").alias("events"))
    return counted.orderBy(F.desc("events"), "risk_level")


def hourly_risk_counts(predictions: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", "timestamp").alias("hour")
    return predictions.groupBy(hour, "risk_level").agg(F.count("*").alias("events"))


def attack_type_counts(predictions: DataFrame) -> DataFrame:
    return (
        predictions.filter(F.col("attack_type").isNotNull())
        .groupBy("attack_type")
        .agg(F.count("*").alias("events"))
        .orderBy(F.desc("events"), "attack_type")
    )


def service_counts(predictions: DataFrame) -> DataFrame:
    counted = predictions.groupBy("service").agg(F.count("*").alias("events"))
    total = counted.agg(F.sum("events")).scalar()
    return counted.withColumn("share", F.col("events") / total).orderBy(F.desc("events"), "service")


def score_histogram(predictions: DataFrame, bins: int = 40, score: str = "anomaly_score") -> DataFrame:
    """Counts per bin of [0, 1] and risk level; a score of 1 falls in the last bin."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return predictions.groupBy(place.alias("bin"), "risk_level").agg(F.count("*").alias("events"))


def score_scatter(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "event_id", "anomaly_score", "rule_score", "risk_level", "event_name", "principal_id"
    )


def score_grid(predictions: DataFrame, bins: int = 40) -> DataFrame:
    """The scatter reduced to a grid, for tables too large to draw point by point."""

    def cell(name: str) -> Column:
        return F.least(F.floor(F.col(name) * bins), F.lit(bins - 1)).cast("int")

    return predictions.groupBy(
        cell("anomaly_score").alias("anomaly_bin"), cell("rule_score").alias("rule_bin"), "risk_level"
    ).agg(F.count("*").alias("events"))


# --- operational metrics -----------------------------------------------------------


def metric_columns(has_error: bool, processed: str | None, time: str = "timestamp") -> list[Column]:
    """Counters of one period, shared by the batch and the streaming form."""
    good = F.col("error").isNull() if has_error else F.lit(True)
    level = F.col("risk_level")
    columns = [
        _count_if(good).alias("events_processed"),
        _count_if(good & (level == "HIGH")).alias("high_risk_incidents"),
        _count_if(good & (level == "MEDIUM")).alias("medium_risk_incidents"),
        _count_if(good & (level == "LOW")).alias("low_risk_events"),
        _count_if(~good).alias("processing_failures"),
    ]
    if processed:
        age = F.unix_micros(processed) - F.unix_micros(time)
        columns.append(F.max(age / 1e6).alias("oldest_age_seconds"))
    return columns


def scoring_metrics(
    df: DataFrame, period: str = PERIOD, time: str = "timestamp", processed: str | None = None
) -> DataFrame:
    """Counters per tumbling period; each event counts once."""
    counted = df.groupBy(F.window(time, period)).agg(
        *metric_columns("error" in df.columns, processed, time)
    )
    return counted.select(F.col("window.start").alias("period_start"), "*").drop("window")


def quarantine_metrics(rejected: DataFrame, period: str = PERIOD, time: str = "arrived_at") -> DataFrame:
    """Quarantined messages per tumbling period of their arrival."""
    counted = rejected.groupBy(F.window(time, period)["start"].alias("period_start"))
    return counted.agg(F.count("*").alias("quarantined"))


def alarms(metrics: DataFrame) -> DataFrame:
    """One row per period and alarm. A missing reading is not a breach."""

    def alarm(name: str, column: str, at_least: float) -> Column:
        reading = F.col(column).cast("double") if column in metrics.columns else F.lit(None).cast("double")
        return F.struct(
            F.lit(name).alias("alarm"),
            reading.alias("reading"),
            F.lit(float(at_least)).alias("at_least"),
            F.coalesce(reading >= at_least, F.lit(False)).alias("breached"),
        )

    rows = F.array(
        alarm("scoring-errors", "processing_failures", 1),
        alarm("quarantined-messages", "quarantined", 1),
        alarm("queue-age", "oldest_age_seconds", MAX_QUEUE_AGE_SECONDS),
    )
    return metrics.select("period_start", F.inline(rows))


def latency_stats(
    df: DataFrame, duration: str, period: str = PERIOD, time: str = "timestamp", share: float = 0.99
) -> DataFrame:
    """Average and exact high percentile of a duration per period."""
    timed = df.select(F.window(time, period)["start"].alias("period_start"), F.col(duration).alias("_d"))
    averages = timed.groupBy("period_start").agg(
        F.count("_d").alias("samples"), F.avg("_d").alias("average")
    )
    high = percentile_by_group(timed, "_d", share, ["period_start"], out="p99")
    return join_same_keys(averages, high, ["period_start"])


#: Normalized rank error of a KLL sketch with Spark's default k = 200, for one quantile, at
#: 99 % confidence (the bound published for this sketch family).
KLL_RANK_ERROR = 0.0133


def latency_sketches(df: DataFrame, duration: str, period: str = "5 minutes", time: str = "timestamp") -> DataFrame:
    """One mergeable KLL sketch of a duration per short period, with its count and sum.

    Stored per period, these are merged into any longer period by :func:`merged_latency`
    without reading the events again; a stream can append them batch by batch.
    """
    return df.groupBy(F.window(time, period)["start"].alias("period_start")).agg(
        F.count(duration).alias("samples"),
        F.sum(F.col(duration).cast("double")).alias("total"),
        F.call_function("kll_sketch_agg_double", F.col(duration).cast("double")).alias("sketch"),
    )


def merged_latency(sketches: DataFrame, period: str, share: float = 0.99) -> DataFrame:
    """Sketches merged into ``period`` (a multiple of theirs): samples, average, the share-quantile.

    The quantile is the merged sketch's; its rank is within ``KLL_RANK_ERROR`` of ``share``.
    A period without durations has 0 samples and null average and quantile.
    """
    rolled = sketches.groupBy(F.window("period_start", period)["start"].alias("period_start")).agg(
        F.sum("samples").alias("samples"),
        F.sum("total").alias("total"),
        F.call_function("kll_merge_agg_double", F.col("sketch")).alias("sketch"),
    )
    # A period whose durations are all null has no sketch to ask.
    estimate = F.when(F.col("samples") > 0, F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), F.lit(share)))
    return rolled.select(
        "period_start", "samples", F.try_divide("total", "samples").alias("average"), estimate.alias("estimate"), "sketch"
    )


def rank_within_bound(
    df: DataFrame, merged: DataFrame, duration: str, period: str, time: str = "timestamp", share: float = 0.99
) -> DataFrame:
    """Per merged period, whether the estimate's exact rank in the events is within the bound."""
    timed = df.select(F.window(time, period)["start"].alias("period_start"), F.col(duration).cast("double").alias("_d"))
    placed = timed.join(merged.select("period_start", "estimate", "samples"), "period_start")
    ranks = placed.groupBy("period_start", "samples").agg(
        F.count_if(F.col("_d") < F.col("estimate")).alias("below"),
        F.count_if(F.col("_d") <= F.col("estimate")).alias("at_most"),
    )
    low = F.try_divide("below", "samples") - KLL_RANK_ERROR
    high = F.try_divide("at_most", "samples") + KLL_RANK_ERROR
    return ranks.select("period_start", ((low <= share) & (F.lit(share) <= high)).alias("within_bound"))


def approximate_latency(
    df: DataFrame, duration: str, period: str = PERIOD, time: str = "timestamp", share: float = 0.99
) -> DataFrame:
    """Single-pass form for streams, where a percentile can only be sketched."""
    return (
        df.groupBy(F.window(time, period))
        .agg(
            F.count(duration).alias("samples"),
            F.avg(duration).alias("average"),
            F.percentile_approx(duration, share, 10_000).alias("p99"),
        )
        .select(F.col("window.start").alias("period_start"), "samples", "average", "p99")
    )
