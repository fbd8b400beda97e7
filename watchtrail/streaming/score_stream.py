"""Queue of messages to incidents, alerts and quarantine, as one streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchtrail.operators.forest import ForestModel
from watchtrail.operators.incidents import build_incidents
from watchtrail.operators.ranking import first_per_key
from watchtrail.operators.score import judge_envelopes, score_accepted
from watchtrail.operators.validate import split_errors
from watchtrail.sources import incident_store
from watchtrail.sources.sinks import insert_incidents, quarantine, write_alerts


def score_batch(batch: DataFrame, batch_id: int, model: ForestModel, folder: str) -> None:
    """Handle one micro-batch. A rejected message never holds up the others.

    Every output of a batch goes to a directory named after it, so a batch that is
    retried after a failure replaces what it wrote before. A failed write fails the batch.
    Messages are opened once for all outputs.
    """
    if "message_file" in batch.columns:
        batch = batch.withColumn("position", F.monotonically_increasing_id()).withColumn(
            "message_id", F.concat_ws(":", "message_file", "position")
        )
    judged = judge_envelopes(batch, model).persist()
    try:
        accepted, rejected = split_errors(judged)
        if {"arrived_at", "position"} <= set(accepted.columns):
            # All rows of a batch get one scoring time, so the first arrival is picked here.
            arrival = [F.col("arrived_at").asc_nulls_last(), F.col("position").asc_nulls_last()]
            accepted = first_per_key(accepted, ["event_id"], arrival)
        incidents = build_incidents(score_accepted(accepted, model), features=None)
        fresh = insert_incidents(incidents, f"{folder}/incidents", batch_id)
        write_alerts(fresh, f"{folder}/alerts", batch_id)
        quarantine(rejected, f"{folder}/quarantine", batch_id)
    finally:
        judged.unpersist()


def stream_score(
    messages: DataFrame,
    model: ForestModel,
    folder: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start scoring. Stored incidents are new ids only, and only those raise alerts."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, batch_id, model, folder)

    return (
        messages.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def dedupe_stream(events: DataFrame, within: str = "1 hour", time: str = "timestamp") -> DataFrame:
    """Drop redeliveries inside a bounded horizon; the store catches later ones."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(["event_id"])


def read_incidents(spark: SparkSession, folder: str) -> DataFrame:
    return incident_store.read_store(spark, f"{folder}/incidents")


def read_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    schema = "message_id string, arrived_at timestamp, body string, error string, batch_id long"
    return spark.read.schema(schema).json(f"{folder}/quarantine").drop("batch_id")
