import json

import pytest
from pyspark.sql import functions as F

from tests.fixtures import HIGH, NORMAL, features_frame
from watchtrail.functions.constants import FEATURES
from watchtrail.operators.incidents import build_incidents
from watchtrail.operators.score import score
from watchtrail.sources import incident_store, sinks
from watchtrail.sources.tables import read_events, read_features


def predictions(spark):
    df = features_frame(spark, HIGH, NORMAL, HIGH).withColumns(
        {
            "event_id": F.concat(F.lit("e"), "id"),
            "timestamp": F.timestamp_seconds(F.col("id") + 1_700_000_000),
            "principal_id": F.lit("p"), "source_ip": F.lit("1.2.3.4"), "event_name": F.lit("E"),
            "service": F.lit("iam"), "region": F.lit(""), "label_binary": (F.col("id") != 1).cast("int"),
        }
    )
    return score(df, F.when(F.col("id") == 1, 0.5).otherwise(-0.5), 0.08)


def test_four_outputs_of_a_batch(spark, tmp_path):
    sinks.write_predictions(predictions(spark).drop("id"), str(tmp_path))
    everything = spark.read.csv(f"{tmp_path}/predictions", header=True, escape='"')
    assert everything.count() == 3
    assert all(isinstance(json.loads(r.reasons), list) for r in everything.collect())
    assert spark.read.json(f"{tmp_path}/incidents").count() == 2
    assert spark.read.csv(f"{tmp_path}/high_risk_incidents", header=True).count() == 2
    summary = json.loads(spark.read.text(f"{tmp_path}/summary").first().value)
    assert (summary["total_events"], summary["high_risk_events"], summary["low_risk_events"]) == (3, 2, 1)
    assert summary["evaluation"]["confusion_matrix"] == [[1, 0], [0, 2]]


def test_insert_never_overwrites_and_replays_safely(spark, tmp_path):
    store = str(tmp_path / "store")
    table = build_incidents(predictions(spark), scored_at=F.col("timestamp"))
    assert table.filter("region IS NOT NULL").count() == 0
    assert sinks.insert_incidents(table.filter("incident_id = 'e0'"), store, 0).count() == 1
    twice = table.unionByName(table)
    assert sinks.insert_incidents(twice, store, 1).count() == 2
    assert sinks.insert_incidents(twice, store, 1).count() == 2
    assert sinks.insert_incidents(twice, store, 2).count() == 0
    stored = incident_store.read_store(spark, store)
    assert sorted(r.incident_id for r in stored.collect()) == ["e0", "e1", "e2"]


def test_feature_table_checks(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    names = [*FEATURES, "label_binary"]
    (tmp_path / "t.csv").write_text(",".join(names) + "\n" + ",".join(["1"] * 12 + ["0"]) + "\n")
    df = read_features(spark, path)
    assert dict(df.dtypes)["api_risk_score"] == "double" and df.count() == 1
    (tmp_path / "short.csv").write_text("hour_of_day\n1\n")
    with pytest.raises(ValueError, match="missing required"):
        read_features(spark, str(tmp_path / "short.csv"))
    (tmp_path / "empty.csv").write_text(",".join(names) + "\n")
    with pytest.raises(ValueError, match="empty"):
        read_features(spark, str(tmp_path / "empty.csv"))


def test_unreadable_lines_are_kept(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"event_id":"a","success":true}\n{oops\n')
    rows = read_events(spark, str(tmp_path / "e.jsonl")).cache().collect()
    assert sorted(r._corrupt_record or r.event_id for r in rows) == ["a", "{oops"]


def test_small_reads_and_reports(spark, tmp_path):
    from watchtrail.operators.incidents import scan_incidents
    from watchtrail.operators.validate import check_predictions
    from watchtrail.sources.models import write_evaluation
    from watchtrail.streaming.metrics import late_rows

    table = predictions(spark)
    assert scan_incidents(table).count() == 3 and scan_incidents(table, 2).count() == 2
    assert check_predictions(table).count() == 0
    assert late_rows(table, 1_700_000_001_000_000).count() == 1
    metrics = spark.sql("SELECT 0.1 anomaly_threshold, 0.8 precision, 0.9 recall, 0.85 f1_score, 0.97 roc_auc, 0.8 pr_auc")
    write_evaluation(metrics, str(tmp_path / "report"))
    report = json.loads(spark.read.text(str(tmp_path / "report")).first().value)
    assert report["metrics"]["pr_auc"]["value"] == report["classification_metrics"]["pr_auc"] == 0.8
