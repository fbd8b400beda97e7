"""Readers for labelled feature tables, raw events and scoring queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtrail.functions import constants as K
from watchtrail.operators.validate import require_columns

EVENT_SCHEMA = (
    "event_id string, timestamp timestamp, account_id string, principal_id string, "
    "event_name string, service string, region string, source_ip string, user_agent string, "
    "success boolean, sensitive_operation boolean, label string, attack_type string, "
    "_corrupt_record string"
)
OPTIONAL_TYPES = {
    "event_id": "string",
    "timestamp": "timestamp",
    "principal_id": "string",
    "event_name": "string",
    "service": "string",
    "region": "string",
    "source_ip": "string",
    "label": "string",
    "attack_type": "string",
}


def read_features(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = K.FEATURES,
    target: str | None = K.TARGET,
    file_format: str = "csv",
) -> DataFrame:
    """Labelled feature table; fails when missing, empty or short of a needed column.

    Only the header of a CSV is looked at to learn which columns there are; the types are
    declared, so no pass over the data infers them.
    """
    needed = [*columns, *([target] if target else [])]
    if file_format == "csv":
        header = spark.read.csv(path, header=True).columns
        types = {**OPTIONAL_TYPES, **dict.fromkeys(columns, "double"), target: "int"}
        schema = ", ".join(f"`{name}` {types.get(name, 'string')}" for name in header)
        df = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
    else:
        df = spark.read.format(file_format).load(path)
    require_columns(df, needed)
    if df.isEmpty():
        raise ValueError(f"The input dataset is empty: {path}")
    return df


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Raw events from JSON lines; an unreadable line is kept in ``_corrupt_record``."""
    return spark.read.schema(EVENT_SCHEMA).json(
        path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record"
    )


def stream_envelopes(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Queue of scoring messages, one per line of each file dropped into a folder.

    A message arrives when its file does; ``score_batch`` names it by its file and place.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(
        F.col("value").alias("body"),
        F.col("_metadata.file_name").alias("message_file"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
    )


def stream_envelopes_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same queue on Kafka; needs the Kafka source on the class path."""
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    return records.select(
        F.col("value").cast("string").alias("body"),
        F.col("timestamp").alias("arrived_at"),
        F.col("offset").alias("position"),
        F.concat_ws(":", "topic", "partition", "offset").alias("message_id"),
    )
