"""Scoring operators built on the shared score columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtrail.functions import constants as K
from watchtrail.functions import scoring as S
from watchtrail.functions.values import once
from watchtrail.operators.features import build_features, numeric_matrix
from watchtrail.operators.validate import (
    parse_envelopes,
    require_columns,
    require_features,
    split_errors,
)
from watchtrail.session import checkpoint_dir

SCORE_COLUMNS = (
    "model_prediction",
    "model_flagged_anomaly",
    "model_decision_value",
    "anomaly_score",
    "rule_score",
    "final_risk_score",
    "risk_level",
    "reasons",
)
METADATA_COLUMNS = (
    "event_id",
    "timestamp",
    "principal_id",
    "event_name",
    "service",
    "region",
    "source_ip",
    "label",
    "label_binary",
    "attack_type",
)


def score(
    df: DataFrame,
    decision: Column,
    threshold: float,
    read: S.FeatureReader = F.col,
) -> DataFrame:
    """Add the eight prediction columns. Levels are decided before rounding."""
    decided = df.withColumn("_decision", decision)
    value = F.col("_decision")
    raw = once(
        decided,
        {
            "_anomaly": S.anomaly_score(value, threshold),
            "_rules": S.rule_score(read),
            "_flagged": S.is_anomalous(value, threshold),
        },
    )
    final = S.final_risk(F.col("_anomaly"), F.col("_rules"))
    flagged = F.col("_flagged")
    return raw.withColumns(
        {
            "model_prediction": F.when(flagged, "suspicious").otherwise("normal"),
            "model_flagged_anomaly": flagged,
            "model_decision_value": F.round("_decision", 6),
            "anomaly_score": F.round("_anomaly", 4),
            "rule_score": F.round("_rules", 4),
            "final_risk_score": F.round(final, 4),
            "risk_level": S.risk_level(final),
            "reasons": S.all_reasons(flagged, S.rule_reasons(read)),
        }
    ).drop("_decision", "_anomaly", "_rules", "_flagged")


def score_dataset(df: DataFrame, model) -> DataFrame:
    """Score a feature table: known metadata columns plus the prediction.

    The model sees missing inputs as 0; the rules see them as missing.
    """
    require_columns(df, model.features)
    filled = {name: F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)) for name in model.features}
    decided = df.withColumn("_value", model.decision(df.sparkSession, lambda n: filled[n]))
    kept = [name for name in METADATA_COLUMNS if name in df.columns]
    return score(decided, F.col("_value"), model.threshold).select(*kept, *SCORE_COLUMNS)


def score_raw_events(df: DataFrame, model, risk_table: DataFrame, home_region: str = K.HOME_REGION) -> DataFrame:
    """Raw events to predictions, with the rolling counters actually computed."""
    featured = numeric_matrix(build_features(df, risk_table, home_region))
    decided = featured.withColumn("_value", model.decision(df.sparkSession))
    return score(decided, F.col("_value"), model.threshold).select(
        "event_id",
        "anomaly_score",
        F.col("final_risk_score").alias("risk_score"),
        "risk_level",
        "reasons",
        F.lit(model.manifest["model_version"]).alias("model_version"),
    )


def judge_envelopes(df: DataFrame, model, body: str = "body") -> DataFrame:
    """Open messages and add ``error``: the contract first, then the model's inputs."""
    checked = require_features(parse_envelopes(df, body), model.features)
    missing = F.concat(
        F.lit("Event is missing required features: "), F.array_join("missing_features", ", ")
    )
    return once(
        checked, {"error": F.coalesce("error", F.when(F.size("missing_features") > 0, missing))}
    ).drop("missing_features")


def score_accepted(accepted: DataFrame, model) -> DataFrame:
    """Score opened messages and name the model that did it."""
    read = lambda name: F.col("features")[name]
    decided = accepted.withColumn("_value", model.decision(accepted.sparkSession, read))
    scored = score(decided, F.col("_value"), model.threshold, read).drop("_value")
    return scored.withColumns(
        {
            "model_name": F.lit(model.manifest["model_name"]),
            "model_version": F.lit(model.manifest["model_version"]),
        }
    )


def score_envelopes(df: DataFrame, model, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(scored messages, rejected messages with ``error``) from raw message text.

    The judged messages are written once, as each of the two would open every message again.
    """
    checkpoint_dir(df.sparkSession)
    accepted, rejected = split_errors(judge_envelopes(df, model, body).checkpoint())
    return score_accepted(accepted, model), rejected
