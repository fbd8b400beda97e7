import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchtrail.operators import evaluate as E


def scored(spark, n=400, seed=2, levels=25):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(levels) / 10, int(rng.random() < 0.3)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id int, s double, label_binary int"), rows


def brute(rows):
    scores, labels = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    best, precision_sum, seen = (-1.0, None), 0.0, 0.0
    for cut in sorted(set(scores)):
        p = labels[scores >= cut].mean()
        r = labels[scores >= cut].sum() / labels.sum()
        f1 = 2 * p * r / max(p + r, 1e-12)
        if f1 > best[0]:
            best = (f1, cut)
    for cut in sorted(set(scores), reverse=True):
        recall = labels[scores >= cut].sum() / labels.sum()
        precision_sum += (recall - seen) * labels[scores >= cut].mean()
        seen = recall
    up, down = scores[labels == 1], scores[labels == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])
    return best, auc, precision_sum


@pytest.mark.parametrize("levels", [1, 3, 25, 100_000])
def test_curve_statistics_against_brute_force(spark, levels):
    df, rows = scored(spark, levels=levels)
    (f1, cut), auc, ap = brute(rows)
    best = E.calibrate_threshold(df, "s").first()
    assert (best.threshold, round(best.f1_score, 12)) == (cut, round(f1, 12))
    assert E.roc_auc(df, "s").first()[0] == pytest.approx(auc)
    assert E.average_precision(df, "s").first()[0] == pytest.approx(ap)


def test_one_class_cannot_be_calibrated(spark):
    df, _ = scored(spark)
    with pytest.raises(Exception, match="only one class"):
        E.calibrate_threshold(df.filter("label_binary = 0"), "s").collect()


def test_split_is_exact_and_stable(spark):
    df, rows = scored(spark, n=503)
    fit, held = E.stratified_split(df)
    positives = sum(r[2] for r in rows)
    got = {r.label_binary: r["count"] for r in held.groupBy("label_binary").count().collect()}
    assert got == {1: int(positives * 0.2 + 0.5), 0: int((503 - positives) * 0.2 + 0.5)}
    assert fit.count() + held.count() == 503
    ids = lambda d: sorted(r.event_id for r in d.select("event_id").collect())
    assert ids(held) == ids(E.stratified_split(df.repartition(16))[1])


def test_split_of_many_labels_is_exact(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("event_id"), (F.col("id") % 5000).alias("label_binary")
    )
    rows = rows.unionByName(spark.range(30_000, 40_000).select(F.col("id").alias("event_id"), F.lit(None).cast("long").alias("label_binary")))
    kept, held = E.stratified_split(rows)
    sizes = {r[0]: r[1] for r in rows.groupBy("label_binary").count().collect()}
    found = {r[0]: r[1] for r in held.groupBy("label_binary").count().collect()}
    assert found == {k: int(n * 0.2 + 0.5) for k, n in sizes.items()}
    assert held.intersect(kept).isEmpty() and held.count() + kept.count() == 40_000


def test_split_without_enough_of_a_class_is_not_stratified(spark):
    df = spark.range(10).select(F.col("id").alias("event_id"), (F.col("id") == 0).cast("int").alias("label_binary"))
    assert E.stratified_split(df)[1].count() == 2


def test_level_metrics_on_the_three_literal_rows(spark):
    rows = [("LOW", False, 0.20, 0.15, 0), ("HIGH", True, 0.90, 0.87, 1), ("MEDIUM", True, 0.60, 0.58, 1), ("HIGH", True, 0.9, 0.9, None)]
    df = spark.createDataFrame(
        rows, "risk_level string, model_flagged_anomaly boolean, anomaly_score double, final_risk_score double, label_binary int"
    )
    row = E.risk_level_metrics(df).first()
    assert (row.precision, row.recall, row.f1_score) == (1.0, 1.0, 1.0)
    assert (row.true_negatives, row.false_positives, row.false_negatives, row.true_positives) == (1, 0, 0, 2)


def test_gates(spark):
    metrics = spark.createDataFrame([(0.8889, 0.8)], "recall double, precision double")
    rows = E.evaluate_gates(metrics).orderBy("position").collect()
    assert [r.line for r in rows] == [
        "recall     0.8889 (required >= 0.70) PASS",
        "precision  0.8000 (required >= 0.70) PASS",
        "pr_auc     0.0000 (required >= 0.65) FAIL",
    ]
    assert not any(r.all_passed for r in rows)


def test_split_sends_the_strata_instead_of_shuffling_rows_by_label(spark):
    df = spark.range(200).select(F.col("id").alias("event_id"), (F.col("id") % 10 == 0).cast("int").alias("label_binary"))
    fitting, held = E.stratified_split(df)
    assert {r.label_binary: r["count"] for r in held.groupBy("label_binary").count().collect()} == {0: 36, 1: 4}
    assert fitting.count() == 160
    assert "strategy=broadcast" in held._jdf.queryExecution().optimizedPlan().toString()
