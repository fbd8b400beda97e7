import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from watchtrail.operators import features as X
from watchtrail.operators.ranking import percentile_by_group

SPANS = {"c": 300, "f": 900, "u": 3600, "i": 3600, "u30": 30}


def busy_events(spark, seed=7, n=600):
    """One principal holds most rows; times are tied, and some principals are missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        who = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        rows.append((f"e{i}", who, rng.randrange(0, 9000), rng.choice(["iam", "s3", "ec2", None]), rng.random() < 0.7))
    df = spark.createDataFrame(rows, "event_id string, principal_id string, s int, service string, success boolean")
    return df.withColumn("timestamp", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")


def counters():
    return [
        X.calls_last(SPANS["c"], "c"),
        X.failed_calls_last(SPANS["f"], "f"),
        X.unique_services_last(SPANS["u"], "u"),
        X.iam_calls_last(SPANS["i"], "i"),
        X.unique_services_last(SPANS["u30"], "u30"),
    ]


def sliding(df):
    def frame(name):
        order = F.unix_micros("timestamp")
        return Window.partitionBy("principal_id").orderBy(order).rangeBetween(-SPANS[name] * 1_000_000, 0)

    return df.select(
        "event_id",
        F.count("*").over(frame("c")).alias("c"),
        F.sum((~F.col("success")).cast("int")).over(frame("f")).alias("f"),
        F.size(F.collect_set("service").over(frame("u"))).cast("long").alias("u"),
        F.coalesce(F.sum((F.col("service") == "iam").cast("int")).over(frame("i")), F.lit(0)).alias("i"),
        F.size(F.collect_set("service").over(frame("u30"))).cast("long").alias("u30"),
    )


def test_counters_equal_a_sliding_frame(spark):
    df = busy_events(spark)
    got = X.rolling_counters(df, counters()).select("event_id", *SPANS)
    want = sliding(df)
    assert got.count() == want.count() == df.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_counters_do_not_depend_on_partitioning(spark):
    df = busy_events(spark, seed=3, n=200)
    results = [
        sorted(map(tuple, X.rolling_counters(df.repartition(n), counters()).select("event_id", *SPANS).collect()))
        for n in (1, 16)
    ]
    assert results[0] == results[1]


def test_calendar_and_flags(spark):
    df = spark.sql(
        "SELECT timestamp'2026-08-10 03:15:00' AS timestamp, false AS success, true AS sensitive_operation, "
        "'eu-west-1' AS region, '203.0.113.77' AS source_ip UNION ALL "
        "SELECT timestamp'2026-08-08 19:59:00', true, false, 'us-east-1', '10.1.2.3'"
    )
    rows = X.external_ip(X.event_flags(X.calendar_features(df))).orderBy("region").collect()
    assert [(r.hour_of_day, r.is_weekend, r.unusual_hour) for r in rows] == [(3, 0, 1), (19, 1, 0)]
    assert [(r.failed_call, r.sensitive_operation, r.outside_home_region, r.external_ip) for r in rows] == [
        (1, 1, 1, 1), (0, 0, 0, 0),
    ]


def test_exact_percentiles_per_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else "cold", float(rng.randrange(40))) for _ in range(500)]
    df = spark.createDataFrame([*rows, ("one", 3.0)], "g string, v double")
    for share in (0.0, 0.37, 0.5, 0.99, 1.0):
        got = {r.g: r.percentile for r in percentile_by_group(df, "v", share, ["g"]).collect()}
        want = {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", share).alias("p")).collect()}
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_time_split_keeps_ties_together(spark):
    df = spark.range(100).withColumn("timestamp", F.timestamp_seconds(F.floor(F.col("id") / 10)))
    train, test = X.time_split(df)
    assert (train.count(), test.count()) == (80, 20)


def test_numeric_matrix_fills_and_rejects(spark):
    import pytest

    df = spark.createDataFrame([(None, "1.5"), (float("nan"), None)], "a double, b string")
    assert sorted(map(tuple, X.numeric_matrix(df, ["a", "b"]).collect())) == [(0.0, 0.0), (0.0, 1.5)]
    bad = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        X.numeric_matrix(bad, ["a"]).collect()
