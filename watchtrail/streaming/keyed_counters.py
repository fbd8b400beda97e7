"""Rolling per-principal counters over a stream, held in keyed state with event-time timers.

Each principal keeps, in RocksDB-backed state, the events of one frame (the longest counter's
span) behind the watermark and the events still waiting for it. An event registers a timer at
its time; when the watermark passes it, the timer counts every waiting event that is now
closed over the frame held, writes it out and drops events that have left the frame. No
history table is kept and no directory is listed per micro-batch: state is bounded by one
frame of events per principal, whatever the age of the stream.

An event that arrives behind the watermark is counted on arrival over the events still held,
so its frame may miss events that expired before it came; within one frame of the watermark
the result equals the batch counters. A busy principal's frame lives in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from watchtrail.operators.features import MICROS, RollingCounter, default_counters


class FrameCounter(StatefulProcessor):
    """Counts closed events of one principal over the frame its state holds."""

    def __init__(self, counters: Sequence[tuple[str, int, bool]]):
        """``counters``: (name, seconds, counts distinct values) of each counter."""
        self.counters = list(counters)
        self.span = max(seconds for _, seconds, _ in self.counters) * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [StructField("at", LongType()), StructField("event_id", StringType()), StructField("waiting", BooleanType())]
        fields += [StructField(f"v{i}", StringType() if distinct else LongType()) for i, (_, _, distinct) in enumerate(self.counters)]
        self.schema = StructType(fields)
        self.frame = handle.getListState("frame", self.schema)

    def _held(self) -> pd.DataFrame:
        rows = list(self.frame.get()) if self.frame.exists() else []
        return pd.DataFrame(rows, columns=self.schema.fieldNames())

    def _counted(self, key, held: pd.DataFrame, due: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("at", kind="stable")
        at = held["at"].to_numpy(np.int64)
        out = {"principal_id": [key[0]] * len(due), "event_id": due["event_id"].tolist(), "at": due["at"].tolist()}
        for i, (name, seconds, distinct) in enumerate(self.counters):
            lo = np.searchsorted(at, due["at"].to_numpy(np.int64) - seconds * MICROS, side="left")
            hi = np.searchsorted(at, due["at"].to_numpy(np.int64), side="right")
            values = held[f"v{i}"]
            if distinct:
                out[name] = [values.iloc[a:b].dropna().nunique() for a, b in zip(lo, hi)]
            else:
                sums = np.concatenate([[0], np.cumsum(values.fillna(0).to_numpy(np.int64))])
                out[name] = (sums[hi] - sums[lo]).tolist()
        return pd.DataFrame(out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = pd.concat(list(rows), ignore_index=True)
        fresh["waiting"] = fresh["at"] > watermark
        fresh = fresh[self.schema.fieldNames()]
        self.frame.appendList(list(fresh.itertuples(index=False, name=None)))
        for at in fresh.loc[fresh["waiting"], "at"].unique():
            self.handle.registerTimer(int(at) // 1000 + 1)
        late = fresh[~fresh["waiting"]]
        if len(late):
            yield self._counted(key, self._held(), late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        due = held[held["waiting"] & (held["at"] <= watermark)]
        if len(due):
            yield self._counted(key, held, due)
        held.loc[due.index, "waiting"] = False
        kept = held[held["waiting"] | (held["at"] >= watermark - self.span)]
        if len(kept):
            self.frame.put(list(kept.itertuples(index=False, name=None)))
        else:
            self.frame.clear()

    def close(self) -> None:
        pass


def keyed_features(
    events: DataFrame,
    folder: str,
    checkpoint: str,
    lateness_seconds: int = 600,
    counters: Sequence[RollingCounter] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start counting into ``folder`` (Parquet, appended), read by :func:`read_keyed_counters`.

    An event is counted once the watermark (latest event time less ``lateness_seconds``) has
    passed it. Counter inputs are computed as columns before the state, so any counter of
    :mod:`watchtrail.operators.features` works. Needs the RocksDB state store provider.
    """
    chosen = list(counters or default_counters())
    values = [
        (F.col(c.distinct).cast("string") if c.distinct else c.adds.cast("long")).alias(f"v{i}") for i, c in enumerate(chosen)
    ]
    prepared = events.withWatermark("timestamp", f"{lateness_seconds} seconds").select(
        "principal_id", "timestamp", F.unix_micros("timestamp").alias("at"), "event_id", *values
    )
    output = "principal_id string, event_id string, at long, " + ", ".join(f"{c.name} long" for c in chosen)
    counted = prepared.groupBy("principal_id").transformWithStateInPandas(
        FrameCounter([(c.name, c.seconds, c.distinct is not None) for c in chosen]), output, "Append", "EventTime"
    )
    shaped = counted.select("principal_id", "event_id", F.timestamp_micros("at").alias("timestamp"), *[c.name for c in chosen])
    return (
        shaped.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )


def read_keyed_counters(spark, folder: str) -> DataFrame:
    return spark.read.parquet(folder)
