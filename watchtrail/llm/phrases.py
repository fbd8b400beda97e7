"""Collocated phrases by dynamic itemset counting over cyclic scans of shards.

The corpus is written once, partitioned into ``shards``, as blocks of texts of one language:
the block's distinct words and its text as numbers of those. Step t reads shard t mod shards
only (partition pruning) and adds its phrase counts to the open counters. Words are counted
from step 0. A phrase one word longer is opened at the first step at which its prefix and its
suffix (each one word shorter) have both reached ``least`` so far; it is found in the data of
the shard being read and counted from that step. A counter closes once it has seen every shard
once, and the scans stop when no counter is open. A phrase occurring ``least`` times has both
sub-phrases at least as frequent, so none is missed.

Tasks count in NumPy. Counters are keyed by a 64-bit hash of the phrase and a check of 31 bits
made from other hashes of its words, and tasks are told by a bitmap per step and length, of a
bounded size, which hashes became frequent before it. A bit that two phrases share may open a
counter early, for a whole cycle all the same. A counter also keeps one block in which its
phrase occurs, its home. A phrase that occurs ``least`` times is named in its home only, so
that each is sent once, however many tasks meet it. Nothing but the bitmaps and the numbers of
frequent phrases by length is collected.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtrail.llm.shared import bitmap, marked, written
from watchtrail.llm.text import blocks, scramble
from watchtrail.session import checkpoint_dir

#: Fixed values of the contract: A-Z is lower-cased, pieces end at ``.,;:!?`` and line ends (here
#: all a full stop), words at space and tab.
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
PIECES = bytes.maketrans(UPPER + b".,;:!?\x0a\x0b\x0c\x0d\t", LOWER + b"." * 10 + b" ")
#: Most bits of a bitmap of frequent phrases, bits it has per phrase up to there, bytes of text in a block.
BITS, EACH = 1 << 26, 32
BLOCK = 1 << 23
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NUMBERED = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("n", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())])
#: A counter's state is (start * SIZES + size) * 2, and 1 more once its phrase is frequent; below
#: it, 32 bits tell its home. Of the blocks that a phrase is in the home is the greatest number,
#: in an order that its key chooses out of SPREAD, so that no block is home to most phrases.
SIZES = 64
SPREAD = np.uint64(16)
COUNTED = "key long, check int, count long, state long"
NAMED = "lang string, size int, phrase string, count long"


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang", shards: int = 4) -> DataFrame:
    """(lang, shard, body) per row: the text, lower-cased and split into pieces when blocks are made.

    A null lang is ``und`` and a null text is empty. A row's shard is a hash of its language
    and text, so repeated rows share a shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(F.col(lang), F.lit("und"))
    return docs.select(key.alias("lang"), body.alias("body")).select(
        "lang", F.pmod(F.xxhash64("lang", "body"), F.lit(shards)).cast("int").alias("shard"), "body"
    )


def grams(words: Column, size: int | Column) -> Column:
    """Every run of ``size`` consecutive words, space-joined."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.size(words) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def gram_hashes(words: np.ndarray, size: int, lang: str) -> np.ndarray:
    """A hash of every run of ``size`` words, given the words' hashes, in a language."""
    total = np.full(max(len(words) - size + 1, 0), xxhash.xxh64_intdigest(lang, size), np.uint64)
    for k in range(size):
        total = (total + words[k : k + len(total)]) * FACTOR
    return scramble(total)


class Numbers(dict):
    """A number for every word met; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (lang, shard, n, words, ids) of texts (lang, shard, body); ``n`` words in all."""
    for batch in batches:
        texts: dict[tuple[int, str], list[bytes]] = {}
        for lang, shard, body in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            texts.setdefault((shard, lang), []).append(body)
        for (shard, lang), bodies in texts.items():
            for lo, hi in blocks(bodies, BLOCK):
                numbers = Numbers({b".": 0})
                words = b" . ".join(bodies[lo:hi]).translate(PIECES).replace(b".", b" . ").split()
                ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                row = {"lang": lang, "shard": shard, "n": np.count_nonzero(ids), "words": b" ".join(numbers), "ids": ids.tobytes()}
                yield pa.RecordBatch.from_pylist([row], NUMBERED)




def write_blocks(pieces_table: DataFrame) -> DataFrame:
    """The texts of :func:`pieces` as written blocks, partitioned by shard."""
    spark = pieces_table.sparkSession
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}/blocks"
    numbered = pieces_table.select("lang", "shard", "body").mapInArrow(_numbered, "lang string, shard int, n long, words binary, ids binary")
    numbered.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return spark.read.schema(numbered.schema).parquet(folder)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray, np.ndarray, int]]:
    """(lang, distinct words, their hashes, other hashes, number of every word, number of the block) per block (lang, words, ids)."""
    for i in range(batch.num_rows):
        joined, ids = batch.column(1)[i].as_py(), batch.column(2)[i].as_buffer()
        words, home = joined.split(b" "), zlib.crc32(ids, zlib.crc32(joined))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        others = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        yield batch.column(0)[i].as_py(), words, hashes, others, np.frombuffer(ids, np.int32).astype(np.int64), home


def home_number() -> Column:
    """The number of a block (words, ids), as :func:`_read` gives it."""
    return F.crc32(F.concat("words", "ids"))


def gram_checks(others: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A check (31 bits) of the ``size`` words from each of the places ``at``, given the words' other hashes."""
    total = np.full(len(at), size, np.uint64)
    for k in range(size):
        total = (total + others[at + k]) * FACTOR
    return (scramble(total) >> np.uint64(33)).astype(np.int32)


def _homes(keys: np.ndarray, home: int) -> np.ndarray:
    """The bits that tell the home of the phrases ``keys``; the same again turns them into ``home``."""
    return (np.uint64(home) ^ ((keys % SPREAD) << np.uint64(28))).view(np.int64)


def _inside(ids: np.ndarray, size: int) -> np.ndarray:
    """For every run of ``size`` words whether it lies inside a piece."""
    single = whole = ids != 0
    for k in range(1, size):
        whole = whole[:-1] & single[k:]
    return whole


def frequent_since(hashes: np.ndarray, inside: np.ndarray, marks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The step from which each phrase is frequent by the bitmaps of the steps, else 0."""
    found = np.zeros(len(hashes), np.int32)
    rest = np.flatnonzero(inside)
    for step, bits in marks:
        hit = marked(bits, hashes[rest])
        found[rest[hit]] = step
        rest = rest[~hit]
    return found


def _summed(keys: np.ndarray, checks: np.ndarray, numbers: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs of key and check with their sums and one of their states."""
    order = np.argsort(keys)
    apart = keys[order[1:]] != keys[order[:-1]]
    if (checks[order[1:]] != checks[order[:-1]])[~apart].any():  # two phrases have one key
        order = np.lexsort((checks, keys))
        apart = (keys[order[1:]] != keys[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
    first = np.flatnonzero(np.concatenate([[True], apart])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(numbers[order], first) if len(keys) else numbers
    order = order[first]
    return keys[order], checks[order], sums, states[order]


def _counter(sizes: list[int], step: int, shards: int, shared: Broadcast):
    """(key, check, count, state) of the phrases of blocks (lang, words, ids) whose counter is open at ``step``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {size: [] for size in sizes}
            for lang, words, distinct, others, ids, home in _read(batch):
                hashes, other = distinct[ids], others[ids]
                for size in sizes:
                    if size == 1:
                        keys, numbers = gram_hashes(distinct, 1, lang)[1:], np.bincount(ids, minlength=len(words))[1:]
                        checks, starts = gram_checks(others, np.arange(1, len(words)), 1), np.zeros(len(keys), np.int64)
                    else:
                        since = frequent_since(gram_hashes(hashes, size - 1, lang), _inside(ids, size - 1), shared.value[size - 1])
                        start = np.maximum(since[:-1], since[1:])
                        at = np.flatnonzero((since[:-1] > 0) & (since[1:] > 0) & (start > step - shards))
                        keys, checks, numbers, starts = _summed(
                            gram_hashes(hashes, size, lang)[at], gram_checks(other, at, size), np.ones(len(at), np.int64), start[at].astype(np.int64)
                        )
                    states = ((starts * SIZES + size) << 33) | _homes(keys, home)
                    found[size].append((keys, checks, numbers, states))
            for parts in found.values():
                keys, checks, numbers, states = _summed(*map(np.concatenate, zip(*parts))) if len(parts) > 1 else parts[0]
                columns = [pa.array(keys.view(np.int64)), pa.array(checks), pa.array(numbers), pa.array(states)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "check", "count", "state"])

    return counted


def _namer(longest: int):
    """(lang, size, phrase, count) of the phrases (key, check, count) that blocks (lang, words, ids, phrases) are home to."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (lang, words, distinct, others, ids, _) in enumerate(_read(batch)):
                own = batch.column(3)[i].values
                keys, checks, counts = (own.field(c).to_numpy() for c in ("key", "check", "count"))
                wanted = dict(zip(zip(keys.tolist(), checks.tolist(), strict=True), counts.tolist(), strict=True))
                keys = np.sort(keys.view(np.uint64))
                hashes, other = distinct[ids], others[ids]
                sizes, phrases, numbers = [], [], []
                for size in range(1, longest + 1):
                    at = np.flatnonzero(_inside(ids, size))
                    found = gram_hashes(hashes, size, lang)[at]
                    hit = keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found
                    at, found = at[hit], found[hit]
                    found, check, _, at = _summed(found, gram_checks(other, at, size), np.ones(len(at), np.int64), at)
                    for place, *pair in zip(at.tolist(), found.view(np.int64).tolist(), check.tolist(), strict=True):
                        if (count := wanted.get(tuple(pair))) is not None:
                            sizes.append(size)
                            phrases.append(b" ".join([words[j] for j in ids[place : place + size]]))
                            numbers.append(count)
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(sizes)), pa.array(sizes, pa.int32())]
                columns += [pa.array(phrases, pa.binary()).view(pa.string()), pa.array(numbers, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "count"])

    return named


def _bits(number: int) -> int:
    return min(BITS, 1 << max(6, (EACH * number).bit_length()))


def _counts(written_blocks: DataFrame, shards: int, least: int, longest: int) -> DataFrame:
    """(lang, size, phrase, count) of the phrases of written blocks that occur ``least`` times or more."""
    spark = written_blocks.sparkSession
    start, size = F.shiftright("state", 33) / SIZES, (F.shiftright("state", 33) % SIZES).cast("int")
    start = F.floor(start).cast("int")
    # What _homes does to the bits that tell a home.
    home = F.col("state").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.shiftleft(F.col("key").bitwiseAND(F.lit(int(SPREAD) - 1)), 28))
    counters = finished = None
    # By size and step: a bitmap of the phrases frequent from that step on, and how many there are.
    marks: dict[int, list[tuple[int, np.ndarray]]] = {size: [] for size in range(1, longest)}
    numbers: dict[int, dict[int, int]] = {}
    step = 0
    while True:
        window = range(max(step - shards, 0) + 1, step + 1)
        sizes = [1] if step < shards else []
        sizes += [s for s in range(2, longest + 1) if any(s - 1 in numbers[at] for at in window)]
        if not sizes:
            break
        shared = spark.sparkContext.broadcast(marks)
        shard = written_blocks.filter(F.col("shard") == step % shards).select("lang", "words", "ids")
        rows = shard.mapInArrow(_counter(sizes, step, shards, shared), COUNTED)
        rows = rows if counters is None else rows.unionByName(counters)
        merged = rows.groupBy("key", "check").agg(F.sum("count").alias("count"), F.max("state").alias("state"))
        often, known = F.col("count") >= least, F.shiftright("state", 32) % 2 == 1
        still_open = start + shards - 1 > step
        counters = written(merged.withColumn("fresh", often & ~known).filter(still_open | often), "counters")
        shared.destroy()
        new = counters.filter(F.col("fresh") | ~still_open)
        new = written(new.select("key", "check", "count", size.alias("size"), home.alias("home"), "fresh", (~still_open).alias("done")), "frequent")
        done = new.filter("done").select("key", "check", "count", "home")
        finished = done if finished is None else finished.unionByName(done)
        new = new.filter("fresh")
        state = F.col("state") + F.shiftleft(F.col("fresh").cast("long"), 32)
        counters = counters.filter(still_open).select("key", "check", "count", state.alias("state"))
        step += 1
        numbers[step] = {r["size"]: r["count"] for r in new.groupBy("size").count().collect()}
        for n in sorted(set(numbers[step]) & set(marks)):
            marks[n].append((step, bitmap(new.filter(F.col("size") == n), "key", _bits(numbers[step][n]))))
    homes = finished.groupBy("home").agg(F.collect_list(F.struct("key", "check", "count")).alias("phrases"))
    found = written_blocks.withColumn("home", home_number()).join(homes.hint("shuffle_hash"), "home")
    # Blocks that are alike have the same phrases.
    return written(found.select("lang", "words", "ids", "phrases").mapInArrow(_namer(longest), NAMED).distinct(), "phrases")


def count_phrases(pieces_table: DataFrame, shards: int = 4, least: int = 30, longest: int = 4) -> DataFrame:
    """Exact counts (lang, size, phrase, count) of every phrase of 1 to ``longest`` words that
    occurs ``least`` times or more.

    ``pieces_table`` is the output of :func:`pieces` with the same ``shards``.
    """
    return _counts(write_blocks(pieces_table), shards, least, longest)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4,
                 share: int = 80, top: int = 2000, shards: int = 4) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words by their weakest cut.

    A candidate occurs ``a >= least`` times. Cutting it after k words gives the counts l and r
    of the two parts and the score floor(2000000 a / (l + r)); the lowest score counts, ties to
    the smallest k. A candidate lying inside a longer candidate that occurs at least ``share``
    per cent as often is dropped. Ranks order by score and a descending, then phrase (UTF-8
    bytes). Null lang is ``und``, null text has no words; words are whatever lies between
    spaces and tabs inside a piece, so repeated rows count twice. Only lang and text are read,
    so other columns, whatever their names, play no part. Columns: lang, rank, phrase, a, l,
    r, n, score (numbers long). Arithmetic is exact in 38-digit decimals.
    """
    numbered = write_blocks(pieces(docs, text, lang, shards))
    totals = numbered.groupBy("lang").agg(F.sum("n").cast("long").alias("n"))
    # A part of a candidate occurs as often as the candidate, so the frequent phrases have all parts.
    single = _counts(numbered, shards, least, longest)
    candidates = single.filter("size >= 2").select("lang", "size", "phrase", F.col("count").alias("a"))
    shorter = candidates.filter("size >= 3").select("lang", "a", "phrase", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("s"))
    inside = shorter.select("lang", "a", F.explode(grams(F.split("phrase", " "), F.col("s"))).alias("phrase"))
    covering = inside.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = candidates.join(covering, ["lang", "phrase"], "left").filter(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * share))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    words = F.split("phrase", " ")
    cuts = cuts.withColumns({"left": F.array_join(F.slice(words, 1, F.col("k")), " "), "right": F.array_join(F.slice(words, F.col("k") + 1, longest), " ")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(single.select("lang", F.col("phrase").alias(side), F.col("count").alias(name)), ["lang", side])
    wide = "decimal(38,0)"
    score = F.expr(f"cast(cast(a as {wide}) * 2000000 div (cast(l as {wide}) + cast(r as {wide})) as bigint)")
    cuts = cuts.withColumn("score", score)
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    scored = weakest.select("lang", "phrase", F.col("a").cast("long").alias("a"), *[F.col(f"w.{c}").cast("long").alias(c) for c in ("l", "r", "score")])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
