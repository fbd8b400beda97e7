import json
import os
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.fixtures import HIGH, NORMAL
from watchtrail.operators.features import rolling_counters
from watchtrail.operators.report import scoring_metrics
from watchtrail.plans.catalog import fixed_forest
from watchtrail.sources.tables import stream_envelopes
from watchtrail.streaming.counters import COUNTERS, read_counters, stream_features
from watchtrail.streaming.metrics import stream_metrics
from watchtrail.streaming.score_stream import (
    dedupe_stream,
    read_incidents,
    read_quarantine,
    stream_score,
)

START = datetime(2026, 8, 10)
EVENTS = "principal_id string, event_id string, timestamp timestamp, success boolean, service string"


def drop_files(folder, *batches):
    """One file per batch, with file times in order."""
    folder.mkdir()
    for n, lines in enumerate(batches):
        target = folder / f"{n}.json"
        target.write_text("\n".join(lines) + "\n")
        os.utime(target, (time.time() - 100 + n, time.time() - 100 + n))


def envelope(name, vector, principal="p"):
    event = {"event_id": name, "timestamp": "2026-08-10T03:15:00Z", "principal_id": principal}
    return json.dumps({"event": event, "features": vector})


def test_scoring_stream_isolates_bad_rows_and_ignores_redelivery(spark, tmp_path):
    drop_files(
        tmp_path / "queue",
        [envelope("a", HIGH), "{bad", envelope("b", NORMAL)],
        [envelope("a", HIGH, "someone-else"), envelope("c", HIGH), envelope("c", HIGH), envelope("d", {"x": 1})],
    )
    messages = stream_envelopes(spark, str(tmp_path / "queue"), files_per_trigger=1)
    model = fixed_forest().with_manifest(anomaly_threshold=-0.2)
    out = str(tmp_path / "out")
    for _ in range(2):
        stream_score(messages, model, out, str(tmp_path / "ck"), {"availableNow": True}).awaitTermination()
    rows = {r.incident_id: r for r in read_incidents(spark, out).collect()}
    assert sorted(rows) == ["a", "b", "c"] and rows["a"].principal_id == "p"
    high = sorted(r.incident_id for r in rows.values() if r.risk_level == "HIGH")
    alerts = spark.read.json(f"{out}/alerts").filter("incident_id IS NOT NULL")
    assert sorted(r.incident_id for r in alerts.collect()) == high == ["a", "c"]
    named = read_quarantine(spark, out).collect()
    assert all(r.message_id and r.arrived_at for r in named)
    errors = sorted(r.error for r in named)
    assert errors[0].startswith("Event is missing required features") and len(errors) == 2


def lines(rows):
    keys = ("principal_id", "event_id", "timestamp", "success", "service")
    return [json.dumps(dict(zip(keys, [r[0], r[1], r[2].isoformat() + "Z", r[3], r[4]], strict=True))) for r in rows]


def some_events(n=300):
    rng = random.Random(4)
    return [
        (
            "hot" if rng.random() < 0.5 else rng.choice("abc"), f"e{i}",
            START + timedelta(seconds=rng.randrange(4 * 3600)), rng.random() < 0.6, rng.choice(["iam", "s3", "ec2"]),
        )
        for i in range(n)
    ]


END = ("zz", "end", START + timedelta(days=2), True, "s3")


def run(spark, df, tmp_path):
    out = str(tmp_path / "out")
    query = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def counted(spark, tmp_path, *batches):
    drop_files(tmp_path / "in", *[lines(batch) for batch in batches])
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream_features(stream, out, str(tmp_path / "ck"), trigger={"availableNow": True}).awaitTermination()
    columns = ["event_id", *COUNTERS]
    return sorted(map(tuple, read_counters(spark, out).filter("event_id <> 'end'").select(columns).collect()))


def test_stream_counters_equal_batch_counters(spark, tmp_path):
    rows = sorted(some_events(), key=lambda r: r[2])
    got = counted(spark, tmp_path, rows[:150], rows[150:], [END])
    want = rolling_counters(spark.createDataFrame(rows, EVENTS)).select("event_id", *COUNTERS)
    assert got == sorted(map(tuple, want.collect()))


def test_late_events_are_still_counted(spark, tmp_path):
    rows = [("a", "x", START, False, "iam"), ("a", "y", START + timedelta(hours=3), True, "s3")]
    late = ("a", "late", START + timedelta(minutes=2), False, "ec2")
    assert counted(spark, tmp_path, rows, [late], [END]) == [
        ("late", 2, 2, 2, 1), ("x", 1, 1, 1, 1), ("y", 1, 0, 1, 0),
    ]


def test_stream_metrics_equal_batch_metrics_and_skip_late_rows(spark, tmp_path):
    rows = some_events(100)
    late = ("a", "late", START - timedelta(hours=5), True, "s3")
    last = ("a", "last", START + timedelta(hours=4), True, "s3")
    # A batch is held to the watermark that was current before the batch ahead of it.
    drop_files(tmp_path / "in", lines(rows), lines([last]), lines([late]), lines([END]))
    rows = [*rows, last]
    level = F.when(F.col("success"), "HIGH").otherwise("LOW")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = run(spark, stream_metrics(stream.withColumn("risk_level", level)), tmp_path)
    want = scoring_metrics(spark.createDataFrame(rows, EVENTS).withColumn("risk_level", level))
    day = F.col("period_start") < F.lit(START + timedelta(days=1))
    assert sorted(map(tuple, got.filter(day).collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_bounded_deduplication(spark, tmp_path):
    rows = some_events(20)
    drop_files(tmp_path / "in", lines(rows), lines(rows))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    assert run(spark, dedupe_stream(stream, "6 hours"), tmp_path).count() == 20


def test_stream_reports_its_late_rows(spark, tmp_path):
    from watchtrail.streaming.metrics import LateRowReport, read_late_rows

    rows = some_events(50)
    late = ("a", "late", START - timedelta(hours=5), True, "s3")
    last = ("a", "last", START + timedelta(hours=4), True, "s3")
    drop_files(tmp_path / "in", lines(rows), lines([last]), lines([late]), lines([END]))
    level = F.when(F.col("success"), "HIGH").otherwise("LOW")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    report = LateRowReport(spark, str(tmp_path / "late"), "metrics_with_late_rows")
    spark.streams.addListener(report)
    try:
        query = (
            stream_metrics(stream.withColumn("risk_level", level)).writeStream.queryName("metrics_with_late_rows")
            .format("memory").outputMode("append").option("checkpointLocation", str(tmp_path / "ck"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        for _ in range(50):
            found = {r.batch_id: r for r in read_late_rows(spark, str(tmp_path / "late")).collect()} if (tmp_path / "late").exists() else {}
            if len(found) >= 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(report)
    assert found[2].input_rows == 1 and found[2].dropped_rows == 1
    assert sum(r.dropped_rows for r in found.values()) == 1
