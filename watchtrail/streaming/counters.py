"""Rolling per-principal counters over a stream.

Keyed state would hold a whole hour of a busy principal in one task. Here the stream only
appends slim rows to a history table; each micro-batch then counts the stretch of time that
has just closed with the batch operator, which spreads one principal over many tasks. Stream
and batch therefore cannot disagree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchtrail.operators.features import (
    MICROS,
    RollingCounter,
    default_counters,
    rolling_counters,
)

COLUMNS = ("principal_id", "event_id", "timestamp", "success", "service")
COUNTERS = (
    "calls_last_5m", "failed_calls_last_5m", "unique_services_last_1h", "iam_calls_last_1h",
)
HISTORY = (
    "principal_id string, event_id string, timestamp timestamp, success boolean, "
    "service string, batch_id long, hour long"
)
HOUR = 3600 * MICROS


def stream_features(
    events: DataFrame,
    folder: str,
    checkpoint: str,
    lateness_seconds: int = 600,
    counters: Sequence[RollingCounter] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start counting. Results land in ``folder``/counters, read by ``read_counters``.

    A row is counted once event time has moved ``lateness_seconds`` past it. A row that
    comes later still is counted on arrival, over the rows known by then.
    """
    chosen = list(counters or default_counters())

    def handle(batch: DataFrame, batch_id: int) -> None:
        count_batch(batch, batch_id, folder, lateness_seconds, chosen)

    return (
        events.select(*COLUMNS)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def count_batch(
    batch: DataFrame,
    batch_id: int,
    folder: str,
    lateness_seconds: int,
    counters: Sequence[RollingCounter],
) -> None:
    """Handle one micro-batch; a retry rewrites the same directories with the same rows."""
    spark = batch.sparkSession
    at = F.unix_micros("timestamp")
    own = f"batch_id={batch_id}"
    hourly = batch.withColumn("hour", F.floor(at / HOUR))
    hourly.write.mode("overwrite").partitionBy("hour").parquet(f"{folder}/history/{own}")
    history = (
        spark.read.schema(HISTORY)
        .option("basePath", f"{folder}/history")
        .parquet(f"{folder}/history")
        .filter(F.col("batch_id") <= batch_id)
    )

    # One row per batch: how far event time has come.
    reached = history.filter(F.col("batch_id") == batch_id).agg(F.max(at).alias("reached"))
    reached.write.mode("overwrite").parquet(f"{folder}/progress/{own}")
    progress = spark.read.schema("reached long, batch_id long").parquet(f"{folder}/progress")
    earlier = F.max(F.when(F.col("batch_id") < batch_id, F.col("reached")))
    row = progress.filter(F.col("batch_id") <= batch_id).agg(
        earlier.alias("earlier"), F.max("reached").alias("latest")
    ).first()
    if row.latest is None:
        return
    closed = row.latest - lateness_seconds * MICROS
    opened = None if row.earlier is None else row.earlier - lateness_seconds * MICROS

    span = max(counter.seconds for counter in counters) * MICROS
    due = (at <= closed) if opened is None else (at <= closed) & (at > opened)
    counted = _counted(history, opened, closed, span, counters).filter(due)
    if opened is not None:
        late = history.filter((F.col("batch_id") == batch_id) & (at <= opened))
        first = late.agg(F.min(at).alias("first")).first().first
        if first is not None:
            # Only the principals concerned are read over the longer stretch.
            theirs = history.join(late.select("principal_id").distinct(), "principal_id", "left_semi")
            again = _counted(theirs, first - 1, opened, span, counters)
            counted = counted.unionByName(again.filter((F.col("batch_id") == batch_id) & (at <= opened)))
    names = [counter.name for counter in counters]
    kept = counted.select("principal_id", "event_id", "timestamp", *names)
    kept.write.mode("overwrite").parquet(f"{folder}/counters/{own}")


def _counted(history, after, until, span, counters) -> DataFrame:
    """Counters over (after, until], with one frame of earlier rows as context."""
    at = F.unix_micros("timestamp")
    rows = history.filter(at <= until)
    if after is not None:
        start = after - span
        rows = rows.filter((F.col("hour") >= start // HOUR) & (at > start))
    return rolling_counters(rows, counters)


def read_counters(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/counters").drop("batch_id")
