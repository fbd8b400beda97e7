"""The one scoring definition, as columns. Batch and streaming jobs both use it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchtrail.functions import constants as K
from watchtrail.functions.values import compact_texts, fires

FeatureReader = Callable[[str], Column]


def anomaly_score(decision: Column, threshold: Column | float) -> Column:
    """Decision value to [0, 1]; exactly 0.5 at the calibrated cutoff."""
    distance = (decision + threshold) * 6.0
    return 1.0 / (1.0 + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), distance))))


def is_anomalous(decision: Column, threshold: Column | float) -> Column:
    return -decision >= threshold


def _bounded_api_risk(read: FeatureReader) -> Column:
    # A missing value scores as the highest API risk: least() skips NULL and ranks NaN last.
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), read("api_risk_score").cast("double")))


def rule_score(read: FeatureReader = F.col) -> Column:
    total = F.lit(0.0)
    for name, weight, _ in K.RULES:
        total = total + F.when(fires(read(name)), weight).otherwise(0.0)
    return F.least(F.lit(1.0), total + _bounded_api_risk(read) * K.API_RISK_WEIGHT)


def rule_reasons(read: FeatureReader = F.col) -> Column:
    sentences = [F.when(fires(read(name)), F.lit(text)) for name, _, text in K.RULES]
    risky = _bounded_api_risk(read) >= K.API_RISK_REASON_FROM
    return compact_texts(*sentences, F.when(risky, F.lit(K.API_RISK_REASON)))


def final_risk(anomaly: Column, rules: Column) -> Column:
    """Blend of the unrounded scores."""
    return F.least(F.lit(1.0), anomaly * K.MODEL_WEIGHT + rules * K.RULE_WEIGHT)


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= K.HIGH_RISK, "HIGH").when(score >= K.MEDIUM_RISK, "MEDIUM").otherwise("LOW")
    )


def all_reasons(flagged: Column, rules: Column) -> Column:
    """Model reason first; a fixed sentence when nothing fired."""
    found = F.when(flagged, F.concat(F.array(F.lit(K.MODEL_REASON)), rules)).otherwise(rules)
    return F.when(flagged | (F.size(rules) > 0), found).otherwise(F.array(F.lit(K.NO_FINDING_REASON)))
