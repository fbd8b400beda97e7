"""Writers for predictions, incidents, rejected messages and alerts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtrail.operators.incidents import alert_payload, new_incidents
from watchtrail.operators.report import filter_risk, incidents_only, summary_document
from watchtrail.sources import incident_store


def write_predictions(predictions: DataFrame, folder: str) -> None:
    """All predictions and the HIGH ones as CSV, incidents as JSON lines, and the summary.

    The predictions are computed once for the four outputs.
    """
    kept = predictions.persist()
    try:
        flat = kept.withColumn("reasons", F.to_json("reasons"))
        flat.write.mode("overwrite").csv(f"{folder}/predictions", header=True, escape='"')
        incidents_only(kept).write.mode("overwrite").json(f"{folder}/incidents")
        filter_risk(flat, "HIGH").write.mode("overwrite").csv(
            f"{folder}/high_risk_incidents", header=True, escape='"'
        )
        summary_document(kept).coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    finally:
        kept.unpersist()


def read_store(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stored incidents; an absent store is empty."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def insert_incidents(incoming: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Append incidents the store lacks; existing ones are never touched.

    The store is an indexed one (:mod:`watchtrail.sources.incident_store`): known ids are
    looked up through a Bloom filter per bucket file, so a batch reads only files that may
    hold its ids. A replay of a batch gives the same store. One writer per store is assumed.
    Triage state belongs in a table of its own, keyed by incident id.
    """
    return incident_store.insert(incoming, path, batch_id)


def quarantine(rejected: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Keep rejected messages with their reason, and their name and arrival where known."""
    target = path if batch_id is None else f"{path}/batch_id={batch_id}"
    named = [c for c in ("message_id", "arrived_at", "position") if c in rejected.columns]
    rejected.select(*named, "body", "error").write.mode("overwrite").json(target)


def write_alerts(incidents: DataFrame, path: str, batch_id: int | None = None) -> None:
    """One alert row per HIGH incident; delivery is left to whatever reads the table."""
    target = path if batch_id is None else f"{path}/batch_id={batch_id}"
    alert_payload(incidents).write.mode("overwrite").json(target)
