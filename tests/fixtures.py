"""Inputs shared by the tests."""

from watchtrail.functions.constants import FEATURES

NORMAL = dict(zip(FEATURES, (11, 0, 0, 0, 0, 0, 0, 2, 0, 2, 0, 0.1), strict=True))
HIGH = dict(zip(FEATURES, (3, 0, 1, 1, 1, 1, 1, 12, 5, 7, 6, 0.98), strict=True))
ODD = dict(zip(FEATURES, (14, 0, 0, 1, 0, 1, 0, 2, 0, 1, 3, 10.0), strict=True))


def features_frame(spark, *vectors):
    schema = "id int, " + ", ".join(f"{n} double" for n in FEATURES)
    rows = [(i, *[None if v[n] is None else float(v[n]) for n in FEATURES]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, schema)
