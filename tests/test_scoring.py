import math

import pytest
from pyspark.sql import functions as F

from tests.fixtures import HIGH, NORMAL, ODD, features_frame
from watchtrail.functions import constants as K
from watchtrail.functions import scoring as S
from watchtrail.functions.values import fixed_text
from watchtrail.operators.score import score

THRESHOLD = 0.08245799398764486


def decision_for(anomaly):
    return math.log(1 / anomaly - 1) / 6 - THRESHOLD


def test_rule_scores(spark):
    rows = features_frame(spark, NORMAL, HIGH, ODD).select("id", S.rule_score().alias("r")).orderBy("id")
    assert [round(row.r, 6) for row in rows.collect()] == [0.025, 0.995, 0.65]


def test_rule_score_is_capped_and_missing_risk_counts_as_highest(spark):
    rows = features_frame(
        spark,
        {**HIGH, "api_risk_score": 10},
        {**NORMAL, "api_risk_score": None},
        {**NORMAL, "api_risk_score": float("nan"), "failed_call": float("nan")},
    )
    got = rows.select("id", S.rule_score().alias("r"), S.rule_reasons().alias("why")).orderBy("id").collect()
    assert [round(row.r, 6) for row in got] == [1.0, 0.25, 0.25]
    assert got[1].why == got[2].why == [K.API_RISK_REASON]


@pytest.mark.parametrize(
    ("vector", "anomaly", "final", "level"),
    [(HIGH, 0.7133, 0.7978, "HIGH"), (NORMAL, (0.3142 - 0.3 * 0.025) / 0.7, 0.3142, "LOW")],
)
def test_published_results(spark, vector, anomaly, final, level):
    df = score(features_frame(spark, vector), F.lit(decision_for(anomaly)), THRESHOLD)
    row = df.first()
    assert (row.final_risk_score, row.risk_level) == (final, level)
    assert row.model_prediction == ("suspicious" if anomaly >= 0.5 else "normal")


def test_levels_at_their_edges(spark):
    values = spark.createDataFrame([(v,) for v in (0.0, 0.39, 0.4, 0.69, 0.7, 1.0)], "v double")
    levels = [r.l for r in values.select("v", S.risk_level(F.col("v")).alias("l")).orderBy("v").collect()]
    assert levels == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]


def test_score_is_half_at_the_cutoff_and_agrees_with_the_flag(spark):
    rows = spark.range(-100, 101).select((F.col("id") / 100 - THRESHOLD).alias("d"))
    got = rows.select(
        "d", S.anomaly_score(F.col("d"), THRESHOLD).alias("a"), S.is_anomalous(F.col("d"), THRESHOLD).alias("f")
    ).orderBy("d").collect()
    assert all((r.a >= 0.5) == r.f for r in got if abs(r.a - 0.5) > 1e-12)
    assert all(x.a >= y.a for x, y in zip(got, got[1:], strict=False))
    centre = spark.range(1).select(S.anomaly_score(F.lit(-THRESHOLD), THRESHOLD)).first()[0]
    assert centre == 0.5


def test_reasons_keep_their_order_and_never_run_empty(spark):
    df = features_frame(spark, HIGH, {**NORMAL})
    rows = score(df, F.when(F.col("id") == 0, -1.0).otherwise(1.0), THRESHOLD).orderBy("id").collect()
    assert rows[0].reasons == [K.MODEL_REASON, *[t for _, _, t in K.RULES], K.API_RISK_REASON]
    assert rows[1].reasons == [K.NO_FINDING_REASON]


def test_fixed_text_rounds_like_the_binary_value(spark):
    values = [0.725, 0.365, 0.125, 0.375, 0.995, 0.005, 1.0, 0.0, 7.999, 9.995, -0.125, 0.03125]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", fixed_text(F.col("v"), 2).alias("two"), fixed_text(F.col("v"), 4).alias("four"))
    for row in got.collect():
        if 0 <= row.v < 8:
            assert row.two == f"{row.v:.2f}"
            assert row.four == f"{row.v:.4f}"


def test_nodes_are_sent_once_per_model(spark):
    from watchtrail.plans.catalog import fixed_forest

    model = fixed_forest()
    first = model.packed(spark)
    assert model.packed(spark) is first and model.with_manifest(model_version="2").packed(spark) is first


def activity_table(spark, folder):
    rows = spark.range(300, numPartitions=1).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id % 7 AS user_id",
        "element_at(array('signup', 'purchase', 'click', 'error', 'view'), CAST(id % 5 + 1 AS INT)) AS event_type",
        "CAST(id % 100 AS DOUBLE) AS value", "concat('{\"k\": ', id % 100, '}') AS props",
    )
    rows.write.parquet(f"{folder}/events.parquet")


def test_messages_are_dealt_over_the_cluster(spark, tmp_path):
    from watchtrail.plans.activity import messages

    activity_table(spark, tmp_path)
    built = messages(spark, str(tmp_path))
    assert built.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert built.count() == built.distinct().count() == 300


def test_messages_are_judged_once_for_both_outputs(spark, tmp_path):
    from watchtrail.operators.score import score_envelopes
    from watchtrail.plans.activity import messages
    from watchtrail.plans.catalog import fixed_forest

    activity_table(spark, tmp_path)
    good, bad = score_envelopes(messages(spark, str(tmp_path)), fixed_forest())
    for df in (good, bad):
        assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert bad.count() > 0 and good.count() + bad.count() == 300
