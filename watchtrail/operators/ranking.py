"""Running totals, exact order statistics and top-k that hold up under skew.

A running total over one big group would put the group in one task. Here rows are cut
into ordered buckets first: each bucket is summed on its own, the few bucket totals are
accumulated, and every bucket starts from what came before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtrail.functions.values import all_of
from watchtrail.session import checkpoint_dir

#: Rows of a bucket that one window task sorts.
BUCKET_ROWS = 1_000_000


def quantile_buckets(df: DataFrame, column: str, out: str, buckets: int | None = None) -> DataFrame:
    """Number rows by equal-count ranges of ``column``, about ``BUCKET_ROWS`` rows to a range.

    The cut points are literals in the plan, so the numbering never depends on how the
    data happens to be partitioned or on a task being retried.
    """
    # One pass gives the row count and a KLL sketch of the column; the cuts are read off it.
    seen = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(column).alias("values"),
        F.call_function("kll_sketch_agg_double", F.col(column).cast("double")).alias("sketch"),
    ).first()
    if buckets is None:
        shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        buckets = max(2, shuffle, -(-seen["rows"] // BUCKET_ROWS))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = []
    if seen["values"]:
        sketch = df.sparkSession.createDataFrame([(bytearray(seen["sketch"]),)], "sketch binary")
        ranks = F.array(*[F.lit(share) for share in shares])
        found = sketch.select(F.call_function("kll_sketch_get_quantile_double", F.col("sketch"), ranks).alias("q")).first()["q"]
        cuts = sorted(set(found))
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    numbered = Bucketizer(splits=splits, inputCol=column, outputCol=out).transform(df)
    return numbered.withColumn(out, F.col(out).cast("int"))


def running_totals(
    df: DataFrame,
    order: Column,
    bucket: str,
    sums: Sequence[str],
    keys: Sequence[str] = (),
    descending: bool = False,
    grand: bool = False,
) -> DataFrame:
    """Add ``running_<name>``: the inclusive cumulative sum in the given order.

    ``bucket`` must rise with ``order``. Rows tied on ``order`` share one total. ``grand``
    also adds ``all_running_<name>``, the group's total, read off the bucket totals.
    """
    direction = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    opening = _opening_balances(df, bucket, sums, keys, direction)
    joined = join_same_keys(df, opening, [*keys, bucket])
    inside = (
        Window.partitionBy(*keys, bucket)
        .orderBy(direction(order))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = {
        f"running_{name}": F.col(f"opening_{name}") + F.sum(name).over(inside) for name in sums
    }
    unwanted = [] if grand else [f"all_running_{name}" for name in sums]
    return joined.withColumns(running).drop(*[f"opening_{name}" for name in sums], *unwanted)


def _opening_balances(df, bucket, sums, keys, direction) -> DataFrame:
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(name).alias(f"total_{name}") for name in sums])
    # One row per key and bucket: the number of buckets bounds each group, not the rows.
    before = (
        Window.partitionBy(*keys)
        .orderBy(direction(F.col(bucket)))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    opening = [
        F.coalesce(F.sum(f"total_{name}").over(before), F.lit(0)).alias(f"opening_{name}")
        for name in sums
    ]
    opening += [
        F.sum(f"total_{name}").over(Window.partitionBy(*keys)).alias(f"all_running_{name}") for name in sums
    ]
    result = totals.select(*keys, bucket, *opening)
    return result if keys else F.broadcast(result)


def join_same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on equal keys, where NULL equals NULL; keys come out once."""
    renamed = right.withColumnsRenamed({name: f"_right_{name}" for name in keys})
    same = all_of([F.col(name).eqNullSafe(F.col(f"_right_{name}")) for name in keys])
    return left.join(renamed, same, "left").drop(*[f"_right_{name}" for name in keys])


def percentile_by_group(
    df: DataFrame,
    value: str,
    share: float,
    keys: Sequence[str] = (),
    out: str = "percentile",
    keep: bool = False,
) -> DataFrame:
    """Exact interpolated percentile per group; one row per group.

    Equal values are counted before the shuffle, and no group is held in one task.
    ``keep`` checkpoints the counts, for a ``df`` that is costly to compute twice.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    if keep:
        checkpoint_dir(df.sparkSession)
        counted = counted.checkpoint()
    ranked = running_totals(
        quantile_buckets(counted, "_v", "_bucket"), F.col("_v"), "_bucket", ["_n"], keys, grand=True
    )
    spread = ranked.withColumnRenamed("all_running__n", "_size")
    position = (F.col("_size") - 1) * F.lit(share)
    low, high = F.floor(position), F.ceil(position)
    first, last = F.col("running__n") - F.col("_n"), F.col("running__n") - 1
    # Each wanted rank falls in exactly one counted value.
    picked = spread.select(
        *keys,
        F.when((first <= low) & (low <= last), F.col("_v")).alias("_low"),
        F.when((first <= high) & (high <= last), F.col("_v")).alias("_high"),
        (position - low).alias("_fraction"),
    )
    return (
        picked.groupBy(*keys)
        .agg(
            F.max("_low").alias("_low"),
            F.max("_high").alias("_high"),
            F.max("_fraction").alias("_fraction"),
        )
        .select(
            *keys,
            (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_fraction")).alias(out),
        )
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per key. Spark trims each group before the shuffle as well."""
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
