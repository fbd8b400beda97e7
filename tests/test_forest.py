import json
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from watchtrail.functions.constants import FEATURES
from watchtrail.operators import evaluate as E
from watchtrail.operators.forest import fit_forest, read_threshold, validate_model
from watchtrail.operators.score import SCORE_COLUMNS, score_dataset
from watchtrail.sources.models import evaluation_document, latest_model, load_model, save_model


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    data = np.vstack([rng.normal(0, 0.5, (360, 12)), rng.normal(6, 0.5, (40, 12))])
    frame = pd.DataFrame(data, columns=list(FEATURES))
    frame.insert(0, "event_id", [f"e{i}" for i in range(400)])
    frame["label_binary"] = [0] * 360 + [1] * 40
    return spark.createDataFrame(frame)


@pytest.fixture(scope="module")
def model(table):
    return E.train(table, n_estimators=60)


def test_planted_outliers_are_found_and_gates_pass(spark, table, model):
    rated = table.select((-model.decision(spark)).alias("s"), (model.decision(spark)).alias("d"), "label_binary")
    metrics = E.evaluate_model(rated, "s", model.threshold)
    assert all(r.passed for r in E.evaluate_gates(metrics).collect())
    plain = E.contamination_baseline(rated, "d").first()
    assert metrics.first().precision > plain.precision
    assert 0.05 < plain.false_positives / 360 < 0.2


def test_forest_does_not_depend_on_partitioning(table):
    normal = table.filter("label_binary = 0")
    one, many = (fit_forest(normal.repartition(n), n_estimators=5) for n in (1, 16))
    order = ["tree_id", "node_id"]
    pd.testing.assert_frame_equal(
        one.nodes.sort_values(order, ignore_index=True), many.nodes.sort_values(order, ignore_index=True)
    )
    assert one.manifest["offset"] == pytest.approx(many.manifest["offset"])


def test_trees_stay_within_their_limits(model):
    nodes = model.nodes
    assert nodes.groupby("tree_id").size().max() <= 511
    roots = nodes[nodes["node_id"] == 0]
    assert len(roots) == 60 and (roots["n_samples"] == 256).all()


def test_no_normal_rows_is_an_error(table):
    with pytest.raises(ValueError, match="no normal"):
        fit_forest(table.filter("label_binary = 1"))


def test_save_load_and_validate(spark, model, tmp_path):
    save_model(spark, model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    validate_model(again)
    assert again.manifest == model.manifest and len(again.nodes) == len(model.nodes)
    broken = again.with_manifest(feature_columns=[])
    with pytest.raises(ValueError, match="feature_columns"):
        validate_model(broken)
    again.nodes.loc[again.nodes["feature"] >= 0, "left"] = 9_999
    with pytest.raises(ValueError, match="child"):
        validate_model(again)


def test_score_dataset_columns_and_ranges(table, model):
    df = score_dataset(table.drop("label_binary"), model)
    assert df.columns == ["event_id", *SCORE_COLUMNS]
    assert df.filter(~F.col("final_risk_score").between(0, 1)).count() == 0
    with pytest.raises(ValueError, match="hour_of_day"):
        score_dataset(table.drop("hour_of_day"), model)


def test_threshold_has_no_fallback():
    assert read_threshold({"anomaly_threshold": 0.125}) == 0.125
    assert read_threshold({"anomaly_threshold": "0.25"}) == 0.25
    for bad in ({}, {"anomaly_threshold": None}, {"anomaly_threshold": "abc"}, {"anomaly_threshold": float("nan")}, {"anomaly_threshold": float("inf")}):
        with pytest.raises(ValueError):
            read_threshold(bad)


def test_latest_model_and_report(spark):
    registry = spark.sql(
        "SELECT * FROM VALUES ('g', 1, timestamp'2026-01-01', 'Approved'), ('g', 2, timestamp'2026-02-01', 'Rejected') "
        "AS t(model_group, version, created_at, status)"
    )
    assert latest_model(registry, "g").first().version == 2
    assert latest_model(registry, "g", "Approved").first().version == 1
    with pytest.raises(ValueError, match="No Approved"):
        latest_model(registry, "none", "Approved")
    metrics = spark.sql("SELECT 0.1 anomaly_threshold, 0.8 precision, 0.9 recall, 0.85 f1_score, 0.97 roc_auc, 0.8 pr_auc")
    text = evaluation_document(metrics).first().value
    assert '"recall":{"value":0.9}' in text and '"classification_metrics"' in text


def test_model_versions_hide_a_half_finished_save(spark, tmp_path):
    from watchtrail.plans.catalog import fixed_forest
    from watchtrail.sources.models import current_version, model_folder

    path = str(tmp_path / "store")
    first = fixed_forest().with_manifest(anomaly_threshold=-0.25)
    assert save_model(spark, first, path) == 1
    second = fixed_forest().with_manifest(anomaly_threshold=-0.3)
    assert save_model(spark, second, path) == 2
    assert load_model(spark, path).manifest["anomaly_threshold"] == -0.3
    # A save that stopped after its trees: no pointer, so readers keep version 2.
    second.trees(spark).write.parquet(f"{path}/versions/{3:012d}/trees")
    assert current_version(spark, path) == 2 and model_folder(spark, path).endswith("000000000002")
    assert load_model(spark, path).manifest["anomaly_threshold"] == -0.3
    older = str(tmp_path / "flat")
    first.trees(spark).coalesce(1).write.parquet(f"{older}/trees")
    spark.range(1).select(F.lit(json.dumps(first.manifest)).alias("value")).write.text(f"{older}/manifest")
    assert load_model(spark, older).manifest["anomaly_threshold"] == -0.25
