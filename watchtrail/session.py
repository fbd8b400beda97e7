"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator assumes; safe to call repeatedly.

    Hours, weekdays and hour buckets are UTC. A checkpoint directory is chosen here
    only when the cluster names none.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch one in local mode only.

    Executors of a cluster cannot read the driver's disk, so there the folder must be named.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="watchtrail-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def as_table(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the checkpoint folder: later reads open only the columns
    they need, and the optimizer knows its size."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
