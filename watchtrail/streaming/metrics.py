"""Operational counters of a stream, and what happens to late rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from watchtrail.operators.report import PERIOD, metric_columns

LATENESS = "10 minutes"


def stream_metrics(
    scored: DataFrame,
    period: str = PERIOD,
    lateness: str = LATENESS,
    time: str = "timestamp",
    processed: str | None = None,
) -> DataFrame:
    """Counters per tumbling period, emitted once the watermark has passed it.

    Rows later than ``lateness`` no longer change a period that was already reported.
    They are still scored and stored: only the counters have a horizon.
    """
    counted = (
        scored.withWatermark(time, lateness)
        .groupBy(F.window(time, period))
        .agg(*metric_columns("error" in scored.columns, processed, time))
    )
    return counted.select(F.col("window.start").alias("period_start"), "*").drop("window")


def late_rows(batch: DataFrame, watermark_us: int, time: str = "timestamp") -> DataFrame:
    """Rows of a micro-batch below a watermark: missing from counters, never from scoring."""
    return batch.filter(F.unix_micros(time) < F.lit(watermark_us))


class LateRowReport(StreamingQueryListener):
    """Writes, for every micro-batch of one named query, the rows its watermark dropped.

    Spark counts them itself (``numRowsDroppedByWatermark`` of each stateful operator); this
    listener keeps them as a table, one JSON file per batch named by its id, so a replayed
    batch replaces its own file. Rows dropped here are missing from the counters only: the
    scoring stream keeps every row. Read the table with :func:`read_late_rows`.
    """

    def __init__(self, spark: SparkSession, folder: str, query_name: str):
        self.spark, self.folder, self.query_name = spark, folder, query_name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.query_name:
            return
        record = {
            "batch_id": progress.batchId,
            "input_rows": progress.numInputRows,
            "dropped_rows": sum(op.numRowsDroppedByWatermark for op in progress.stateOperators),
            "watermark": progress.eventTime.get("watermark"),
        }
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{progress.batchId:012d}.json")
        stream = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
        try:
            stream.write(bytearray((json.dumps(record) + "\n").encode()))
        finally:
            stream.close()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    schema = "batch_id long, input_rows long, dropped_rows long, watermark string"
    return spark.read.schema(schema).json(folder)
