from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from watchtrail.functions.values import fixed_text
from watchtrail.session import checkpoint_dir


def session(master: str, named: str | None):
    folders = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: folders[0] if folders else None, setCheckpointDir=folders.append
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named or default)), folders


def test_a_cluster_must_name_its_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(session(master, None)[0])
        one, folders = session(master, "file:///shared")
        assert checkpoint_dir(one) == "file:///shared" and folders == ["file:///shared"]
    assert checkpoint_dir(session("local[4]", None)[0])


def test_fixed_text_has_one_rounding_rule(spark):
    values = [0.725, 0.995, 9.995, 8.125, 123.455, 7.995, 0.005, 2.5, 1e-9, 99.999, -0.725, -9.995, 0.0, 1e15, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(fixed_text(F.col("v"), 2)).collect()] == [f"{v:.2f}" for v in values]
