"""Near-duplicate vectors of one label by a forest of random-projection trees.

Every tree splits vectors by the median of a random projection, again and again. A vector
within the spill margin of a split goes to both sides, so near pairs are parted rarely; and
trees are many, so that a pair parted in one meets in another. Vectors are compared within
leaves, in double precision, and a pair is counted in the first leaf that it shares.

Splits are fitted on at most ``SAMPLE`` vectors drawn by hash; every vector is placed.
Directions belong to a level of a tree, thresholds to a node while the sample reaches it
and to the level beyond, so the forest stays small at any number of vectors. The depth
follows the number of vectors of the largest label. Equal vectors of a label are one class
and are counted, not compared. A leaf that does not split further (near copies) is compared
in blocks, so no task holds more than two blocks.

Links found are exact. Which links are found depends on the splits: the recall against
brute force is in the README and in the tests.

Vectors that are null, zero, or hold a null or non-finite component, and vectors without a
label, link with nothing. Only vectors of equal length are compared. Rows that share an id
are one vector with several values; a row without an id counts for its class's links only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtrail.llm.shared import components, written
from watchtrail.llm.top_scores import usable

SIMILAR = 0.98
TREES = 4
LEAF = 256
BLOCK = 512
SAMPLE = 20_000
#: A node with fewer sample vectors takes the threshold of its level.
LEAST = 32
#: Margin in units of the spread that a just similar pair's difference has along a direction.
SPILL = 1.0


class Tree(NamedTuple):
    directions: np.ndarray  # (levels, attributes)
    middles: np.ndarray  # threshold of a level
    nodes: list[dict[int, float]]  # threshold of a node, by level


def units(vectors: list | pd.Series) -> np.ndarray:
    found = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    found = found / np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def grow(sample: np.ndarray, levels: int, trees: int = TREES, seed: int = 5) -> list[Tree]:
    random = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        directions = random.normal(size=(levels, sample.shape[1]))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        middles, nodes = np.zeros(levels), []
        code = np.zeros(len(sample), dtype=np.int64)
        for level in range(levels):
            along = sample @ directions[level]
            middles[level] = np.median(along) if len(along) else 0.0
            own = {}
            order = np.argsort(code, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if len(part) >= LEAST:
                    own[int(code[part[0]])] = float(np.median(along[part]))
            nodes.append(own)
            cut = np.array([own.get(int(c), middles[level]) for c in code])
            code = code * 2 + (along > cut)
        grown.append(Tree(directions, middles, nodes))
    return grown


def leaves(vectors: np.ndarray, forest: list[Tree], margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that each vector reaches; a leaf's number names its tree."""
    rows, found = [], []
    for number, tree in enumerate(forest):
        row, code = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
        for level, middle in enumerate(tree.middles):
            along = (vectors @ tree.directions[level])[row]
            own = tree.nodes[level]
            cut = np.array([own.get(int(c), middle) for c in code])
            low, high = along <= cut + margin, along > cut - margin
            row, code = np.concatenate([row[low], row[high]]), np.concatenate([code[low] * 2, code[high] * 2 + 1])
        rows.append(row)
        found.append(code | number << 48)
    return np.concatenate(rows), np.concatenate(found)


def placed(classes: DataFrame, forest: list[Tree], margin: float) -> DataFrame:
    """A row per class and leaf, with all the leaves of the class in order."""
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, leaf = leaves(units(batch.column("embedding").to_pylist()), shared.value, margin)
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(leaf, pa.int64()))
            yield batch.append_column("leaves", lists)

    fields = "label string, node long, copies long, embedding array<double>"
    rows = classes.select("label", "node", "copies", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(place, f"{fields}, leaves array<long>").withColumn("leaf", F.explode("leaves"))


def compared(rows: pd.DataFrame, similar: float) -> pd.DataFrame:
    """Links first met here, summed per node, and links that span what is linked here.

    ``rows`` are one block of a leaf (part 0), or two (parts 0 and 1) to be compared across.
    """
    rows = rows.sort_values("node")
    leaf = rows["leaf"].iloc[0]
    vectors, node = units(rows["embedding"]), rows["node"].to_numpy()
    part, copies = rows["part"].to_numpy(), rows["copies"].to_numpy()
    across = part.any()
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    for at in range(0, len(rows), BLOCK):
        near[at : at + BLOCK] = vectors[at : at + BLOCK] @ vectors.T >= similar
    np.fill_diagonal(near, False)
    if across:
        near &= part[:, None] != part[None]
    active = np.flatnonzero(near.any(axis=1))
    if not len(active):
        return pd.DataFrame({"node": [], "other": [], "links": []})
    near = near[np.ix_(active, active)]
    node, copies = node[active], copies[active]
    # Pairs that share an earlier leaf are counted there.
    earlier = [np.array([x for x in own if x < leaf], dtype=np.int64) for own in rows["leaves"].to_numpy()[active]]
    seen, place = np.unique(np.concatenate(earlier), return_inverse=True)
    counted = near
    if len(seen):
        member = np.zeros((len(active), len(seen)), dtype=np.float32)
        member[np.repeat(np.arange(len(active)), [len(e) for e in earlier]), place] = 1
        counted = near & (member @ member.T == 0)
    least = np.arange(len(active))
    while True:
        then = np.minimum(least, np.where(near, least[None], len(active)).min(axis=1))
        if (then == least).all():
            break
        least = then
    tied = np.flatnonzero(least != np.arange(len(active)))
    links = counted @ copies
    sums = pd.DataFrame({"node": node[links > 0], "other": node[links > 0], "links": links[links > 0]})
    spans = pd.DataFrame({"node": node[tied], "other": node[least[tied]], "links": 0})
    return pd.concat([sums, spans]).astype("int64")


def compare_leaves(rows: DataFrame, similar: float) -> DataFrame:
    """(node, other, links): see ``compared``; leaves beyond one block meet block by block."""

    def within(group: pd.DataFrame) -> pd.DataFrame:
        return compared(group, similar)

    keys = ["label", "size", "leaf"]
    rows = written(rows.withColumn("size", F.size("embedding")), "placed")
    sizes = written(rows.groupBy(*keys).count().filter("count > 1"), "sizes")
    rows = rows.join(sizes, keys).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    low, high = F.least("own", "with"), F.greatest("own", "with")
    rows = rows.withColumns({"low": low, "high": high, "part": (F.col("own") > low).cast("int")}).drop("own", "with")
    return rows.groupBy(*keys, "low", "high").applyInPandas(within, "node long, other long, links long")


def near_vectors(vectors: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    linked = F.col("label").isNotNull() & usable("embedding") & F.exists("embedding", lambda x: x != 0)
    hashes = [F.xxhash64(F.lit(i), "embedding").alias(f"h{i}") for i in (1, 2)]
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"), F.coalesce(linked, F.lit(False)).alias("linked"), *hashes, "embedding"
    )
    rows = written(rows, "rows")
    key = ["label", "h1", "h2"]
    classes = rows.filter("linked").groupBy(*key).agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )
    classes = written(classes, "classes")
    known = classes.filter("node is not null")
    most = known.groupBy("label").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    levels = max(0, math.ceil(math.log2(max(1, (most["most"] or 0) / LEAF))))
    width = known.agg(F.max(F.size("embedding"))).first()[0] or 1
    drawn = known.filter(F.size("embedding") == width).orderBy(F.xxhash64("node")).select("embedding").limit(SAMPLE)
    sample = drawn.toArrow().column(0).to_pylist() if levels else []
    sample = units(sample) if sample else np.zeros((0, width))
    forest = grow(sample, levels)
    margin = SPILL * math.sqrt(2 - 2 * similar) / math.sqrt(width)
    found = written(compare_leaves(_all_lengths(known, forest, width, margin), similar), "found")

    parts = components(found.filter("node <> other"), "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = classes.select(*key, "node", "copies").join(links, "node", "left").join(parts, "node", "left")
    own = own.select(
        *key,
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "node").alias("component_id"),
    )
    own = written(own, "own")
    found = rows.select("vec_id", *key, "linked").join(own, key, "left")
    part = F.when(F.col("linked"), F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id"))
    return found.select(
        "vec_id",
        F.when(F.col("linked"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        part.alias("component_id"),
        F.col("vec_id").eqNullSafe(part).alias("kept"),
    )


def _all_lengths(known: DataFrame, forest: list[Tree], width: int, margin: float) -> DataFrame:
    """Vectors of the greatest length go through the forest, shorter ones into one leaf per label."""
    longest = placed(known.filter(F.size("embedding") == width), forest, margin)
    shorter = known.filter(F.size("embedding") < width).select(
        "label", "node", "copies", F.col("embedding").cast("array<double>").alias("embedding"), F.array(F.lit(0).cast("long")).alias("leaves")
    )
    return longest.unionByName(shorter.withColumn("leaf", F.lit(0).cast("long")))
