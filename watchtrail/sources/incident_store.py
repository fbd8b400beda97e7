"""An append-only incident store whose insert-if-absent opens only files that may hold an id.

Layout under the store's root::

    data/part=<name>/bucket=<k>/*.parquet    incidents, hash-bucketed by incident id
    bloom/part=<name>/bucket=<k>/*.parquet   one Bloom filter per data file, as 4 KB bitmaps
    state/<version>.json                     the live parts, published last

A part is one micro-batch (``b`` and its number) or one compacted generation (``g``). A
batch computes, for each incoming id, its bucket and ``HASHES`` bit positions, broadcasts
these probes (their number is checked), and joins them to the filters of the live parts on
(part, bucket, chunk); the join on the partition column lets Spark prune filter files of
buckets the batch does not touch. Only the data files of (part, bucket) pairs whose filter
answers for some id are then opened. Compaction folds batch parts into one generation, so
the files a batch consults stay bounded by (1 + ``KEEP``) parts per bucket however old the
store is. A new state file is created, never overwritten, after the data it names exists,
so a reader sees a whole batch or none of it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchtrail.operators.incidents import first_deliveries

#: Buckets per part, hash functions per id, bits per id (about 1 % false answers) and
#: batch parts allowed beside the generation before compaction folds them in.
BUCKETS, HASHES, BITS_PER_ID, KEEP = 64, 7, 10, 8
#: Bits of one bitmap row (Spark's bitmap functions use 4 KB bitmaps).
CHUNK = 32768
#: Most probe rows a batch may broadcast; larger batches join the filters by shuffle.
BROADCAST_PROBES = 2_000_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def state(spark: SparkSession, root: str) -> dict:
    """The newest published state: ``{"version": n, "parts": [...]}``; empty for a new store."""
    fs, folder = _fs(spark, f"{root}/state")
    if not fs.exists(folder):
        return {"version": 0, "parts": []}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    versions = sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))
    if not versions:
        return {"version": 0, "parts": []}
    stream = fs.open(_fs(spark, f"{root}/state/{versions[-1]:012d}.json")[1])
    try:
        raw = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(raw)


def _publish(spark: SparkSession, root: str, parts: list[str], version: int, schema: str) -> dict:
    """Create the next state file; fails if another writer created it first."""
    found = {"version": version, "parts": parts, "schema": schema}
    fs, target = _fs(spark, f"{root}/state/{version:012d}.json")
    stream = fs.create(target, False)
    try:
        stream.write(bytearray(json.dumps(found).encode()))
    finally:
        stream.close()
    return found


def bucket_of(incident_id: Column) -> Column:
    return F.pmod(F.xxhash64(incident_id), F.lit(BUCKETS)).cast("int")


def _positions(incident_id: Column, bits: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), incident_id), bits) for i in range(HASHES)])


FILTER = "bits long, chunk long, bitmap binary, part string, bucket int"


def _write_part(rows: DataFrame, root: str, part: str) -> DataFrame:
    """Data files of one part and the Bloom filter of each; returns the part as written."""
    keyed = rows.withColumn("bucket", bucket_of(F.col("incident_id")))
    keyed.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/part={part}")
    stored = rows.sparkSession.read.schema(keyed.schema).parquet(f"{root}/data/part={part}")
    written = stored.select("incident_id", "bucket")
    sizes = written.groupBy("bucket").agg((F.ceil(F.count(F.lit(1)) * BITS_PER_ID / CHUNK) * CHUNK).cast("long").alias("bits"))
    spots = written.join(sizes, "bucket").select(
        "bucket", "bits", F.explode(_positions(F.col("incident_id"), F.col("bits"))).alias("at")
    )
    filters = spots.groupBy("bucket", "bits", (F.col("at") / CHUNK).cast("long").alias("chunk")).agg(
        F.expr(f"bitmap_construct_agg(at % {CHUNK})").alias("bitmap")
    )
    filters.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/bloom/part={part}")
    return stored.drop("bucket")


def _live(spark: SparkSession, root: str, kind: str, parts: list[str], schema: str | None = None) -> DataFrame | None:
    """The named parts of ``data`` or ``bloom``, with ``part`` and ``bucket`` columns."""
    if not parts:
        return None
    reader = spark.read.option("basePath", f"{root}/{kind}")
    if kind == "bloom":
        reader = reader.schema(FILTER)
    elif schema:
        reader = reader.schema(T.StructType.fromJson(json.loads(schema)).add("part", T.StringType()).add("bucket", T.IntegerType()))
    return reader.parquet(*[f"{root}/{kind}/part={p}" for p in parts])


def maybe_holding(ids: DataFrame, root: str, parts: list[str]) -> list[tuple[str, int]]:
    """(part, bucket) of every data file whose Bloom filter answers for one of the ids.

    The list is bounded by parts times buckets, whatever the number of ids.
    """
    spark = ids.sparkSession
    filters = _live(spark, root, "bloom", parts)
    if filters is None:
        return []
    sizes = filters.select("part", "bucket", "bits").distinct()
    probes = (
        ids.select("incident_id").distinct().withColumn("bucket", bucket_of(F.col("incident_id")))
        .join(F.broadcast(sizes), "bucket")
        .select("incident_id", "part", "bucket", F.explode(_positions(F.col("incident_id"), F.col("bits"))).alias("at"))
        .select("incident_id", "part", "bucket", (F.col("at") / CHUNK).cast("long").alias("chunk"), (F.col("at") % CHUNK).alias("bit"))
    )
    few = probes.count() <= BROADCAST_PROBES
    hits = filters.join(F.broadcast(probes) if few else probes, ["part", "bucket", "chunk"])
    byte = "cast(conv(hex(substring(bitmap, cast(bit div 8 AS int) + 1, 1)), 16, 10) AS int)"
    hits = hits.filter(F.expr(f"shiftright({byte}, cast(bit % 8 AS int)) & 1 = 1"))
    answered = hits.groupBy("incident_id", "part", "bucket").count().filter(F.col("count") == HASHES)
    return [(r.part, r.bucket) for r in answered.select("part", "bucket").distinct().collect()]


def read_store(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """Every stored incident of the published state; empty (with ``schema``) for a new store."""
    current = state(spark, root)
    found = _live(spark, root, "data", current["parts"], current.get("schema"))
    if found is None:
        return spark.createDataFrame([], schema or "incident_id string")
    return found.drop("part", "bucket")


def compact(spark: SparkSession, root: str, before: int | None = None, keep: int = KEEP) -> dict:
    """Fold batch parts (numbered below ``before``) into one generation once more than ``keep`` exist.

    The generation is written beside the old parts and published in a new state; readers of
    an older state still find the files they listed, which :func:`vacuum` removes later.
    """
    current = state(spark, root)
    batches = [p for p in current["parts"] if p.startswith("b") and (before is None or int(p[1:]) < before)]
    if len(batches) <= keep:
        return current
    folded = [p for p in current["parts"] if p.startswith("g")] + batches
    name = f"g{int(batches[-1][1:]):012d}"
    rows = _live(spark, root, "data", folded, current["schema"]).drop("part", "bucket")
    _write_part(rows, root, name)
    rest = [p for p in current["parts"] if p not in folded]
    return _publish(spark, root, [name, *rest], current["version"] + 1, current["schema"])


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete parts the newest state no longer names; returns their names."""
    live = set(state(spark, root)["parts"])
    gone = []
    for kind in ("data", "bloom"):
        fs, folder = _fs(spark, f"{root}/{kind}")
        if not fs.exists(folder):
            continue
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("part=") and name[5:] not in live:
                fs.delete(status.getPath(), True)
                gone.append(name[5:])
    return sorted(set(gone))


def insert(incoming: DataFrame, root: str, batch_id: int, keep: int = KEEP) -> DataFrame:
    """Append the first delivery of each id the store lacks; stored incidents never change.

    A replay of a batch ignores its own part when it looks for known ids and rewrites it, so
    the outcome is the same. Before the batch, older batch parts are compacted when more than
    ``keep`` exist. One writer per store is assumed; a second one fails on publishing.
    """
    spark = incoming.sparkSession
    current = compact(spark, root, before=batch_id, keep=keep)
    part = f"b{batch_id:012d}"
    others = [p for p in current["parts"] if p != part]
    first = first_deliveries(incoming)
    files = maybe_holding(first, root, others)
    fresh = first
    if files:
        paths = [f"{root}/data/part={p}/bucket={b}" for p, b in sorted(files)]
        known = spark.read.option("basePath", f"{root}/data").schema("incident_id string").parquet(*paths)
        fresh = first.join(known, "incident_id", "left_anti")
    stored = _write_part(fresh, root, part)
    if part not in current["parts"]:
        _publish(spark, root, [*current["parts"], part], current["version"] + 1, first.schema.json())
    return stored
