from datetime import timedelta

from tests.test_streaming import END, EVENTS, START, drop_files, lines, some_events
from watchtrail.operators.features import rolling_counters
from watchtrail.streaming.counters import COUNTERS
from watchtrail.streaming.keyed_counters import keyed_features, read_keyed_counters


def counted(spark, tmp_path, *batches):
    drop_files(tmp_path / "in", *[lines(batch) for batch in batches])
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    keyed_features(stream, out, str(tmp_path / "ck"), trigger={"availableNow": True}).awaitTermination()
    columns = ["event_id", *COUNTERS]
    return sorted(map(tuple, read_keyed_counters(spark, out).filter("event_id <> 'end'").select(columns).collect()))


def test_keyed_counters_equal_batch_counters(spark, tmp_path):
    rows = sorted(some_events(), key=lambda r: r[2])
    rows.append((None, "nobody", START + timedelta(minutes=1), None, None))
    got = counted(spark, tmp_path, rows[:150], rows[150:], [END])
    want = rolling_counters(spark.createDataFrame(rows, EVENTS)).select("event_id", *COUNTERS)
    assert got == sorted(map(tuple, want.collect()))


def test_keyed_counters_wait_for_the_watermark(spark, tmp_path):
    rows = [("a", "x", START, False, "iam"), ("a", "y", START + timedelta(hours=3), True, "s3")]
    late = ("a", "late", START + timedelta(hours=2, minutes=58), False, "ec2")
    assert counted(spark, tmp_path, rows, [late], [END]) == [
        ("late", 1, 1, 1, 0), ("x", 1, 1, 1, 1), ("y", 2, 1, 2, 0),
    ]
