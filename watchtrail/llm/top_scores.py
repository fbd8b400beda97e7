"""Exact top-k by inner product over a bit-sliced index.

Vectors become integers, floor(256 * x) per component. A block of rows holds, for every
attribute, bitmaps of its highest bits (the slices). A query adds the slices that its
weights' bits select with bitmap adders, three bitmaps into a sum and a carry, until one
bitmap per binary place is left: the bit-sliced sum of all rows at once. The k-th largest
sum is read from the most significant slice downward. The bits left out of the slices bound
how far a sum can be off; rows within that bound of the k-th are resolved exactly from
their integers, so the result is exact.

All rows are indexed, in blocks of ``BLOCK_ROWS``; queries go to the blocks in groups of
``QUERY_ROWS``, and every block returns at most k rows per query. No task holds more than
one block and one group of queries.

Vectors that are null, or hold a null or non-finite component, and rows without an id take
no part. Of rows that share an id the smallest vector counts. A shorter vector is filled
with zeros. Components are limited to 2 ** 18 in size, so that scores fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchtrail.llm.shared import written

BLOCK_ROWS = 16_384
QUERY_ROWS = 128
SLICES = 5
LIMIT = float(2**18)


def usable(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )


def integers(vectors: pd.Series) -> np.ndarray:
    width = max((len(v) for v in vectors), default=0)
    found = np.zeros((len(vectors), width))
    for i, vector in enumerate(vectors):
        found[i, : len(vector)] = np.asarray(vector, dtype=np.float64)
    return np.floor(256.0 * np.clip(found, -LIMIT, LIMIT)).astype(np.int32)


def pack_bits(rows: np.ndarray) -> np.ndarray:
    """A bitmap of 64-bit words from booleans along the last axis."""
    words = -(-rows.shape[-1] // 64)
    padded = np.zeros((*rows.shape[:-1], words * 64), dtype=bool)
    padded[..., : rows.shape[-1]] = rows
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


class Block:
    """The bit-sliced attributes of some rows, and the rows' integers."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        self.low = values.min(axis=0).astype(np.int64) if values.size else np.zeros(values.shape[1], dtype=np.int64)
        above = values - self.low
        most = int(above.max()) if values.size else 0
        self.shift = max(0, most.bit_length() - SLICES)
        coarse = above >> self.shift
        self.bits = max(1, (most >> self.shift).bit_length())
        planes = [(coarse >> i & 1).astype(bool).T for i in range(self.bits)]
        # [attribute, sign of the weight, bit]: a negative weight adds the complement.
        plain = np.stack([pack_bits(p) for p in planes], axis=1)
        self.rows = pack_bits(np.ones(len(ids), dtype=bool))
        self.slices = np.stack([plain, ~plain & self.rows], axis=1)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bitmaps, lowest place first, of sum |weight| * (attribute or its complement)."""
        size = np.abs(weights)
        sign = (weights < 0).astype(np.int64)
        places: list[list[np.ndarray]] = []
        for j in range(int(size.max(initial=0)).bit_length()):
            at = np.flatnonzero(size >> j & 1)
            if len(at):
                chosen = self.slices[at, sign[at]]
                for i in range(self.bits):
                    while len(places) <= i + j:
                        places.append([])
                    places[i + j].append(chosen[:, i])
        found, k = [], 0
        while k < len(places):
            stack = np.concatenate(places[k]) if places[k] else np.zeros((1, len(self.rows)), dtype=np.uint64)
            while len(stack) > 1:
                third = max(1, len(stack) // 3)
                a, b = stack[:third], stack[third : 2 * third]
                c = stack[2 * third : 3 * third] if len(stack) > 2 else np.zeros_like(a)
                half = a ^ b
                if k + 1 == len(places):
                    places.append([])
                places[k + 1].append((a & b) | (c & half))
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            found.append(stack[0])
            k += 1
        return found

    def top(self, weights: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than ``own``, ties to the smaller id."""
        width = min(len(weights), self.values.shape[1])
        query = np.zeros(self.values.shape[1], dtype=np.int64)
        query[:width] = weights[:width]
        exists = self.rows & ~pack_bits(self.ids == own)
        near = self._near(self.sums(query), exists, k, np.abs(query).sum())
        rows = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        scores = self.values[rows].astype(np.int64) @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]

    def _near(self, sums: list[np.ndarray], exists: np.ndarray, k: int, weight: int) -> np.ndarray:
        above, equal, kth = np.zeros_like(exists), exists, 0
        for place in reversed(range(len(sums))):
            ones = equal & sums[place]
            if int(np.bitwise_count(above | ones).sum()) >= k:
                equal, kth = ones, kth | 1 << place
            else:
                above, equal = above | ones, equal & ~sums[place]
        # The bits left out add between 0 and (2**shift - 1) * |weight| to what 2**shift * sum says.
        least = kth - -(-int(weight) * ((1 << self.shift) - 1) // (1 << self.shift))
        if least <= 0:
            return exists
        above, equal = np.zeros_like(exists), exists
        for place in reversed(range(len(sums))):
            if least >> place & 1:
                equal = equal & sums[place]
            else:
                above, equal = above | (equal & sums[place]), equal & ~sums[place]
        return above | equal


def _stored(keys: dict[str, int], ids: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    row = keys | {"ids": ids.astype("<i8").tobytes(), "attributes": values.shape[1], "data": values.astype("<i4").tobytes()}
    return pd.DataFrame([row])


def _loaded(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], dtype="<i8")
    return ids, np.frombuffer(row["data"], dtype="<i4").reshape(len(ids), int(row["attributes"]))


def in_blocks(vectors: DataFrame, key: str, count: int) -> DataFrame:
    """One row per block with its ids and integers; ``vectors`` has (vec_id, embedding)."""

    def stored(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        return _stored({key: int(rows[key].iloc[0])}, rows["vec_id"].to_numpy(), integers(rows["embedding"]))

    dealt = vectors.withColumn(key, F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
    return dealt.groupBy(key).applyInPandas(stored, f"{key} int, ids binary, attributes int, data binary")


def top_scores(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the best rows for every row that ``queries`` selects."""
    valid = vectors.filter(F.col("vec_id").isNotNull() & usable("embedding"))
    valid = valid.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))
    valid = written(valid, "vectors")
    asked = valid.filter(queries)
    rows, asks = valid.count(), asked.count()
    n_blocks, n_groups = max(1, -(-rows // BLOCK_ROWS)), max(1, -(-asks // QUERY_ROWS))
    index = written(in_blocks(valid, "block", n_blocks), "index")
    groups = written(in_blocks(asked, "asking", n_groups), "queries")
    index = index.withColumn("asking", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    groups = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def searched(blocks: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_search(blocks, asking, k)), columns=["query_id", "vec_id", "score"])

    keys = ["block", "asking"]
    found = index.groupBy(*keys).cogroup(groups.groupBy(*keys))
    found = found.applyInPandas(searched, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(blocks: pd.DataFrame, asking: pd.DataFrame, k: int) -> Iterator[tuple[int, int, int]]:
    for _, held in blocks.iterrows():
        block = Block(*_loaded(held))
        for _, asked in asking.iterrows():
            for query, weights in zip(*_loaded(asked), strict=True):
                ids, scores = block.top(weights.astype(np.int64), k, query)
                yield from ((int(query), int(i), int(s)) for i, s in zip(ids, scores, strict=True))
