"""Adapter that reads the ``events`` test table as cloud audit activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtrail.operators.features import build_features, numeric_matrix
from watchtrail.operators.incidents import build_incidents
from watchtrail.operators.score import score
from watchtrail.operators.validate import build_envelopes
from watchtrail.session import checkpoint_dir

THRESHOLD = 0.08245799398764486

API_RISK = (
    ("CreateAccessKey", 0.98),
    ("AttachUserPolicy", 0.95),
    ("GetMetricData", 0.10),
    ("ListBuckets", 0.20),
    ("GetObject", 0.30),
    ("DescribeInstances", 0.25),
)


def risk_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{name}', double({risk}))" for name, risk in API_RISK)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(event_name, api_risk_score)")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, user = F.col("event_type"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    hour = F.hour("ts")
    outside = k % 4 == 0
    sensitive = kind.isin("signup", "purchase")
    return events.select(
        F.concat(F.lit("evt-"), F.col("event_id")).alias("event_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("user-"), user).alias("principal_id"),
        F.when(kind == "signup", "CreateAccessKey")
        .when(kind == "purchase", "AttachUserPolicy")
        .when(kind == "click", "GetObject")
        .when(kind == "error", "DescribeInstances")
        .when(k % 7 == 0, "GetMetricData")
        .otherwise("ListBuckets")
        .alias("event_name"),
        F.when(sensitive, "iam")
        .when(kind == "click", "s3")
        .when(kind == "error", "ec2")
        .when(k % 7 == 0, "cloudwatch")
        .otherwise("s3")
        .alias("service"),
        F.when(k % 10 == 0, "eu-west-1")
        .when(k % 10 == 1, "us-west-2")
        .otherwise("us-east-1")
        .alias("region"),
        F.when(outside, F.concat(F.lit("203.0.113."), user % 254 + 1))
        .otherwise(F.concat(F.lit("10.0."), user % 4, F.lit("."), k + 1))
        .alias("source_ip"),
        (kind != "error").alias("success"),
        sensitive.alias("sensitive_operation"),
        (outside & sensitive & ((hour < 6) | (hour > 19))).cast("int").alias("label_binary"),
        (0.25 - F.col("value") / 400).alias("decision_value"),
        F.col("value"),
    )


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(activity(spark, sf_dir), risk_table(spark))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored activity with the stand-in decision value, so any engine can repeat it."""
    return score(featured(spark, sf_dir), F.col("decision_value"), THRESHOLD)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored incidents: one per scored event, timed by the event so that runs agree."""
    return build_incidents(scored(spark, sf_dir), scored_at=F.col("timestamp"))


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table of their own, for operators that read it more than once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the cluster, for costly work on each of them.

    A scan has no more tasks than the file has row groups, and adaptive reads merge by bytes.
    """
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, "event_id", "timestamp")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue records over the activity; some are damaged in a way their number tells."""
    built = build_envelopes(numeric_matrix(spread(featured(spark, sf_dir))))
    seq, body = F.col("seq"), F.col("body")
    extra_key = F.concat(F.lit('{"featurez":1,'), F.substring(body, F.lit(2), F.length(body)))
    bad_ip = F.regexp_replace(body, '"source_ip":"[^"]*"', '"source_ip":"not-an-ip"')
    damaged = (
        F.when(seq % 17 == 0, F.substring(body, F.lit(1), F.length(body) - 20))
        .when(seq % 19 == 0, F.concat(F.lit('{"hour_of_day":'), seq % 24, F.lit("}")))
        .when(seq % 23 == 0, extra_key)
        .when(seq % 29 == 0, bad_ip)
        .when(seq % 31 == 0, F.concat(body, F.lit("]")))
        .when(seq % 37 == 0, F.concat(body, F.lit("] junk")))
        .when(seq % 41 == 0, F.concat(body, F.lit("}")))
        .when(seq % 43 == 0, F.concat(body, F.lit(","), body))
        .when(seq % 47 == 0, F.concat(body, F.lit(" junk")))
        .when(seq % 53 == 0, F.translate(body, '"', "'"))
        .when(seq % 59 == 0, F.concat(body, F.lit(" // note")))
        .when(seq % 61 == 0, F.replace(body, F.lit('"hour_of_day":'), F.lit('"hour_of_day":0')))
        .when(seq % 67 == 0, F.replace(body, F.lit('{"schema_version"'), F.lit('{"features":{},"schema_version"')))
        .when(seq % 71 == 0, F.replace(body, F.lit('"features":{'), F.lit('"features":{"is_weekend":0,')))
        .otherwise(body)
    )
    return built.select(F.concat(F.lit("msg-"), seq).alias("message_id"), damaged.alias("body"))
