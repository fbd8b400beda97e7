"""Helpers the corpus operators share: written tables, bitmaps of hashes, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtrail.session import checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch, so that a batch of very long texts fits a worker's memory.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "33554432"}
#: The same where several operators' workers share an executor's memory.
SMALL_BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in a session whose Arrow batches are limited in bytes."""
    for key, value in BATCH_BYTES.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Make the session's Arrow batches small, until a table is read by :func:`table`."""
    for key, value in SMALL_BATCH_BYTES.items():
        spark.conf.set(key, value)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and is computed once.

    The table survives the loss of executors. It stays until the folder is cleaned. The
    shuffle files behind it are of no more use and go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(rows: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` (a power of two from 64 up) that has the bit of every ``key`` (a hash, long).

    It is of that size whatever the number of rows; :func:`marked` may let others through.
    """
    place = F.col(key).bitwiseAND(F.lit(bits - 1))
    bit = F.expr(f"shiftleft(1L, cast({key} & 63 as int))")
    words = rows.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return found.view(np.uint64)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each of ``keys`` (unsigned 64-bit) whether its bit is set in a :func:`bitmap`."""
    words = bits[(keys & np.uint64(len(bits) * 64 - 1)) >> np.uint64(6)]
    return (words >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component_id) for every node of the links; the id is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows pointers once more,
    and contracts the links onto the pointers. Links shrink by more than half per round,
    all steps are joins and partial aggregates, and each round is a written table.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b").distinct()
    edges = written(edges, "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        pointers = written(least.select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "pointers")
        again = pointers.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = pointers.join(again, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        jumped = written(jumped, "jumped")
        if labels is None:
            labels = jumped.select("node", F.col("to").alias("component_id"))
        else:
            step = jumped.select(F.col("node").alias("component_id"), "to")
            labels = labels.join(step, "component_id", "left").select(
                "node", F.coalesce("to", "component_id").alias("component_id")
            )
            labels = written(labels, "labels")
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(jumped.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        edges = written(ends.filter("a <> b").distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    return labels
