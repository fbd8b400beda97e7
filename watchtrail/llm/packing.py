"""Packing documents into sequences: shortest-pack-first over the histogram of lengths.

Documents are tokenised once and cut into full sequences and one rest. White space parts
words before the vocabulary applies, so a worker looks up the ids of words it has met. The counts of the
piece lengths (at most one per length, so small at any corpus size) go to the driver, which
places lengths longest first, each into the emptiest packs that still have room, and keeps
counts of equal packs instead of the packs. Pieces then find their pack by their rank among
the pieces of equal length.

One length may hold a third of all pieces, so ranks are counted in cells of a length, with
the sizes of earlier cells added. The number of cells follows the number of pieces.

Nulls: a null text is empty and yields its end token only; a null id packs like any other.
Repeated rows are packed as rows of their own. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchtrail.llm.shared import written
from watchtrail.llm.token_count import byte_symbols

SEQUENCE = 2048
END = 1
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
#: Words whose ids a worker remembers; the memory is emptied when full.
MEMORY = 500_000
CHARACTERS = 1 << 21
CELL_ROWS = 100_000
LEAST_CELLS = 256
# str.split() also splits at these, the tokenizer does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Words of these characters have no normal form, contraction or special token to heed:
#: runs of letters, single digits and runs of other marks are tokenised one by one.
PLAIN = re.compile("[!-&(-;=-~\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-\xff]+")
PARTS = re.compile(r"[^\W\d_]+|\d|[\W_]+")


class WordIds:
    """The ids of words, as little-endian 32-bit numbers, remembered by the worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.symbols = {b: c for c, b in byte_symbols().items()}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        body = self.parts.get(part)
        if body is None:
            symbols = part.encode().decode("latin-1").translate(self.symbols)
            body = array("I", [t.id for t in self.tokenizer.model.tokenize(symbols)]).tobytes()
            self.parts[part] = body
        return body

    def word(self, word: str) -> bytes:
        if (body := self.words.get(word)) is None:
            plain = PLAIN.fullmatch(word)
            body = b"".join(map(self.part, PARTS.findall(word.lower()))) if plain else self.encode(word)
            self.words[word] = body
        return body

    def text(self, text: str) -> bytes:
        if NOT_SPACE.search(text):
            return self.encode(text)
        for known in (self.words, self.parts):
            if len(known) > MEMORY:
                known.clear()
        words = text.split()
        found = list(map(self.words.get, words))
        if None in found:
            found = [self.word(w) if b is None else b for w, b in zip(words, found, strict=True)]
        return b"".join(found)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def text_groups(texts: list[str], limit: int = CHARACTERS) -> Iterator[list[int]]:
    group, size = [], 0
    for i, text in enumerate(texts):
        group.append(i)
        size += len(text)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def cut(docs: DataFrame, path: str, *, sequence: int = SEQUENCE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces of the token ids of (id, text): full sequences from the start, then the rest.

    With ``keep_ids`` each piece carries its ids as little-endian 32-bit numbers.
    """
    last = np.array([end], dtype="<u4").tobytes()
    width = 4 * sequence

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for group in text_groups(texts):
                rows: list[tuple] = []
                for i in group:
                    body = known.text(texts[i]) + last
                    for at in range(0, len(body), width):
                        part = body[at : at + width]
                        row = (ids[i], at // 4, len(part) // 4, zlib.crc32(part), len(body) // 4)
                        rows.append((*row, part) if keep_ids else row)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.mapInArrow(pieces, PIECES + (", ids binary" if keep_ids else ""))


def plan_packs(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """(number of packs, lengths in the pack) for every pattern; lengths are placed longest first.

    Each length goes to the emptiest open packs that have room for it, one per pack and pass.
    """
    open_packs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    rooms: list[int] = []

    def put(count: int, pack: list[int], room: int) -> None:
        if not open_packs[room]:
            insort(rooms, room)
        open_packs[room].append((count, pack))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            number, pack = open_packs[room].pop()
            if not open_packs[room]:
                rooms.pop(bisect_left(rooms, room))
            used = min(number, left)
            if number > used:
                put(number - used, pack, room)
            put(used, [*pack, length], room - length)
            left -= used
        if left:
            each = sequence // length
            full, rest = divmod(left, each)
            if full:
                put(full, [length] * each, sequence - each * length)
            if rest:
                put(1, [length] * rest, sequence - rest * length)
    return [pattern for packs in open_packs.values() for pattern in packs]


def places(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, repeats in a pack) of each pattern's lengths."""
    taken: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for number, pack in patterns:
        offset = 0
        for length in sorted(set(pack), reverse=True):
            repeats = pack.count(length)
            start = taken[length]
            taken[length] = start + number * repeats
            rows.append((length, start, taken[length], first, offset, repeats))
            offset += repeats * length
        first += number
    return rows


def pack(docs: DataFrame, path: str, *, sequence: int = SEQUENCE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` (id, text) with its ``sequence_id`` and ``offset``.

    ``path`` is the tokenizer's file, which every executor must be able to open.
    """
    spark = docs.sparkSession
    pieces = written(cut(docs, path, sequence=sequence, end=end, keep_ids=keep_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(
        places(plan_packs(counts, sequence)),
        "length int, first long, upto long, base long, place int, repeats int",
    )
    cells = max(LEAST_CELLS, sum(counts.values()) // CELL_ROWS)
    order = ("start", "doc_id", "ids_crc32", "doc_tokens")
    celled = pieces.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    sizes = celled.groupBy("length", "cell").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(W.partitionBy("length").orderBy("cell")) - F.col("rows")
    before = written(sizes.withColumn("before", before).drop("rows"), "cells")
    place = F.row_number().over(W.partitionBy("length", "cell").orderBy(*order)) - 1
    ranked = celled.withColumn("rank", place).join(before, ["length", "cell"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "cell")
    # At most a few rows per length of a sequence, whatever the size of the corpus.
    here = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("upto"))
    at = F.col("rank") - F.col("first")
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & here).drop(slots["length"])
    return placed.select(
        *pieces.columns,
        (F.col("base") + F.floor(at / F.col("repeats"))).cast("long").alias("sequence_id"),
        (F.col("place") + at % F.col("repeats") * F.col("length")).cast("long").alias("offset"),
    )
