import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from watchtrail.operators import report as P

START = datetime(2026, 8, 10)


def test_merged_sketches_keep_counts_and_rank_bound(spark):
    draw = random.Random(5)
    rows = [(START + timedelta(seconds=draw.randrange(3 * 3600)), draw.lognormvariate(3, 1)) for _ in range(20_000)]
    rows += [(START + timedelta(minutes=7), None), (START + timedelta(hours=5), None)]
    events = spark.createDataFrame(rows, "timestamp timestamp, value double")
    short = P.latency_sketches(events, "value", "5 minutes")
    merged = P.merged_latency(short, "1 hour")
    checked = merged.join(P.rank_within_bound(events, merged, "value", "1 hour"), "period_start", "left").collect()
    assert len(checked) == 4
    for row in checked:
        values = np.array([v for t, v in rows if v is not None and row.period_start <= t < row.period_start + timedelta(hours=1)])
        assert row.samples == len(values)
        if len(values):
            assert abs(row.average - values.mean()) < 1e-9 * max(1.0, values.mean())
            rank = (values <= row.estimate).mean()
            assert abs(rank - 0.99) <= P.KLL_RANK_ERROR + 1 / len(values) and row.within_bound
        else:
            assert row.average is None
    once = events.groupBy(F.window("timestamp", "1 hour")["start"].alias("period_start")).agg(F.count("value").alias("n"))
    assert sorted((r.period_start, r.n) for r in once.collect()) == sorted((r.period_start, r.samples) for r in checked)
