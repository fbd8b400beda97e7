"""Near-duplicate documents by a signature-coordinate inverted join.

A document is its set of five-word shingles. A MinHash signature has ``COORDINATES``
coordinates; documents are posted under coordinate-value pairs, and two documents are
compared in full when they collide in at least ``MATCHES`` coordinates, which a pair at the
threshold misses with probability below 1e-5.

How little is posted (prefix merging): coordinate-value pairs are ordered by rarity over the
corpus. Of its pairs that any other document shares, a document is posted under the rarest
``shared - MATCHES + 1`` only; two documents with enough collisions meet there. Documents
with fewer shared pairs are skipped, which is most of a corpus, and pairs that a common
passage brings come last in the order.

How groups of copies stay linear: equal sets are one class from the start. Every class is
first compared with one other, the smallest id it meets; the links join most of a group of
near copies. After that only members of different components are compared (skip merging):
those outside the component of a list's first member, with the members of the list, in
blocks; and where a link has joined two components, their other pairs are skipped too.
Every candidate is confirmed on full sets, so links are exact and no list is capped.

A null or empty text, or one without words, has an empty set and links with nothing. Rows
that share an id are one document with several texts. A row with a null id joins its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtrail.llm.shared import components, small_batches, written
from watchtrail.llm.text import SMALL_BLOCK, blocks, scramble, word_hashes

WORDS = 5
SIMILAR = 85  # percent
COORDINATES = 24
MATCHES = 12
BITS = 0xA0761D6478BD642F
LIST_BLOCK = 256
MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = "doc_id long, n long, h1 long, h2 long, pairs array<long>, marks binary"


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each lower-cased text; a short text is one shingle."""
    found = []
    for first, end in blocks(texts, SMALL_BLOCK):
        hashes, bounds = word_hashes([t.lower() for t in texts[first:end]])
        weights = [pow(0xD6E8FEB86659FD93, i, 2**64) for i in range(1, words + 1)]
        size = max(0, len(hashes) - words + 1)
        rolled = np.zeros(size, dtype=np.uint64)
        for i, weight in enumerate(weights):
            rolled += hashes[i : i + size] * np.uint64(weight)
        rolled = scramble(rolled)
        for at, stop in zip(bounds[:-1], bounds[1:], strict=True):
            if stop - at >= words:
                found.append(np.unique(rolled[at : stop - words + 1]))
            elif stop > at:
                short = np.uint64(stop - at)
                for h, weight in zip(hashes[at:stop], weights, strict=False):
                    short = scramble(np.array([short + h * np.uint64(weight)]))[0]
                found.append(np.array([short], dtype=np.uint64))
            else:
                found.append(np.empty(0, dtype=np.uint64))
    return found


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None] * MULTIPLIERS
        np.minimum(least, part.min(axis=0), out=least)
    return least >> np.uint64(32)


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, set size, two hashes of the set, coordinate-value pairs, one byte per coordinate)."""
    place = np.arange(COORDINATES, dtype=np.int64) << 32

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, pairs, marks = [], [], [], [], []
            with np.errstate(over="ignore"):
                for first, end in blocks(texts := _encoded(batch), SMALL_BLOCK):
                    for own in shingle_sets(texts[first:end]):
                        least = signature(own)
                        n.append(len(own))
                        h1.append(int(own.sum(dtype=np.uint64).view(np.int64)))
                        h2.append(int(scramble(own ^ np.uint64(BITS)).sum(dtype=np.uint64).view(np.int64)))
                        pairs.append(place + least.astype(np.int64) if len(own) else ())
                        marks.append(least.astype(np.uint8).tobytes())
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, h1, h2))]
            columns += [pa.array(pairs, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h1", "h2", "pairs", "marks"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(signed, SIGNATURE)


def postings(classes: DataFrame) -> DataFrame:
    """(token, node, n, marks): every class under its rarest shared coordinate-value pairs."""
    entries = classes.select("node", "n", "marks", F.explode("pairs").alias("token"))
    shared = entries.groupBy("token").count().filter("count > 1")
    shared = written(shared, "shared")
    held = entries.join(shared, "token").groupBy("node", "n", "marks")
    held = held.agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("held"))
    prefix = F.slice("held", F.lit(1), F.size("held") - MATCHES + 1)
    posted = held.filter(F.size("held") >= MATCHES).select("node", "n", "marks", F.explode(prefix["token"]).alias("token"))
    return written(posted, "postings")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set): the shingle hashes of the documents named in ``nodes``."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in blocks(texts := _encoded(batch), SMALL_BLOCK):
                sets = pa.array([s.tobytes() for s in shingle_sets(texts[first:end])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), sets], ["node", "set"])

    wanted = docs.join(nodes.withColumnRenamed("node", "doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    return written(wanted.select("doc_id", "text").mapInArrow(opened, "node long, set binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("left"), batch.column("right"), strict=True)
            keep = [similar(*(np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in pair)) for pair in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    right = sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("left"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(checked, "a long, b long")


def links_across(posted: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components, enough of them to join all that are linked.

    Only lists that hold several components are looked at. A list is held in blocks; the
    members outside the component of the list's first member ask in every block.
    """
    own = labels.withColumnRenamed("component_id", "part")
    placed = posted.join(own, "node", "left").withColumn("part", F.coalesce("part", "node"))
    placed = written(placed, "placed")
    lists = placed.groupBy("token").agg(
        F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("rows"), F.min_by("part", "node").alias("main")
    )
    lists = written(lists.filter("lo <> hi").select("token", "rows", "main"), "lists")
    count = F.ceil(F.col("rows") / LIST_BLOCK).cast("int")
    rows = placed.join(lists, "token").withColumn("count", count).withColumn("asks", F.col("part") != F.col("main"))
    held = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("count")).cast("int")).withColumn("held", F.lit(True))
    # In a list of one block a row both asks and is held; in a longer one it asks in every block.
    asking = rows.filter("asks and count > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    held = held.withColumn("asks", F.col("asks") & (F.col("count") == 1))
    every = held.unionByName(asking.withColumn("held", F.lit(False)))
    keys = ["token", "block"]
    every = every.select(*keys, "node", "part", "n", "marks", "asks", "held").join(sets, "node")
    every = every.repartition(*keys).sortWithinPartitions(*keys)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            pairs = spanning_links(group)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return every.mapInArrow(met, "a long, b long").distinct()


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal (token, block) in sorted batches, as arrays."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        bounds = _bounds(rows)
        yield from _runs(rows.slice(0, bounds[-2]), bounds[:-1])
        rest = rows.slice(bounds[-2])
    if rest is not None and rest.num_rows:
        yield from _runs(rest, np.array([0, rest.num_rows]))


def _bounds(rows: pa.Table) -> np.ndarray:
    keys = [rows.column(k).to_numpy() for k in ("token", "block")]
    change = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    return np.concatenate([[0], np.flatnonzero(change) + 1, [rows.num_rows]])


def _runs(rows: pa.Table, bounds: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    if not rows.num_rows:
        return
    columns = {k: rows.column(k).to_numpy() for k in ("node", "part", "n", "asks", "held", "set")}
    marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)
    for at, end in zip(bounds[:-1], bounds[1:], strict=True):
        if end - at > 1:
            yield {k: v[at:end] for k, v in columns.items()} | {"marks": marks[at:end]}


def spanning_links(group: dict[str, np.ndarray]) -> np.ndarray:
    """Links between those that ask and those held, each of which joins two components of the group."""
    held, asks = np.flatnonzero(group["held"]), np.flatnonzero(group["asks"])
    node, part, size = group["node"], group["part"], group["n"]
    known: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in known:
            known[i] = np.frombuffer(group["set"][i], dtype=np.uint64)
        return known[i]

    root = {int(p): int(p) for p in np.unique(part)}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    found = []
    for i in asks:
        same = (group["marks"][held] == group["marks"][i]).sum(axis=1)
        close = 100 * np.minimum(size[i], size[held]) >= SIMILAR * np.maximum(size[i], size[held])
        able = held[(same >= MATCHES) & close & (part[held] != part[i])]
        # The likeliest first: once two components are joined, their other pairs need no look.
        for j in able[np.argsort(-same[np.searchsorted(held, able)], kind="stable")]:
            if find(int(part[i])) != find(int(part[j])) and similar(shingles(i), shingles(j)):
                root[find(int(part[i]))] = find(int(part[j]))
                found.append((min(node[i], node[j]), max(node[i], node[j])))
    return np.array(found, dtype=np.int64).reshape(-1, 2)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets share enough of their union."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < SIMILAR * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= SIMILAR * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = written(signatures(docs), "signatures")
    key = ["h1", "h2", "n"]
    classes = signed.filter("n > 0").groupBy(*key).agg(
        F.min("doc_id").alias("node"), F.first("pairs").alias("pairs"), F.first("marks").alias("marks")
    )
    classes = written(classes, "classes")
    posted = postings(classes.filter("node is not null"))
    sets = full_sets(docs, posted.select("node").distinct())

    leaders = written(posted.groupBy("token").agg(F.min("node").alias("leader")), "leaders")
    star = posted.join(leaders, "token").groupBy("node").agg(F.min("leader").alias("a")).filter("a < node")
    links = written(confirmed(star.select("a", F.col("node").alias("b")), sets), "links0")
    labels = components(links)
    more = written(links_across(posted, labels, sets), "links1")
    if not more.isEmpty():
        labels = components(links.union(more))

    part = classes.select(*key, "node").join(labels, "node", "left")
    part = written(part.select(*key, F.coalesce("component_id", "node").alias("component_id")), "parts")
    same: Column = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return (
        signed.select("doc_id", *key)
        .join(part, key, "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", same)
    )
