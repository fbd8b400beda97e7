"""Language-model scores by deleted interpolation of word bigrams.

P(word | word before) mixes the maximum-likelihood estimates of the bigram and of the word
with a uniform share for words never met. The weights depend on how often the context was
met (buckets by powers of two) and are learnt by expectation-maximisation on held-out
counts: a tenth of the training documents is deleted from the counts, and its own bigrams,
seen through the counts of the rest, say which mixture suits each bucket. Scores then use
the counts of all training documents.

Every document's bigrams need counts that are spread over the corpus. Documents are dealt
into blocks by hash. A block sends each distinct n-gram once, with its own counts, to the
n-gram's range of hashes; the range adds up, and answers only where the total differs from
what the block already knows. Since most n-grams occur in one block only, answers are few.
N-grams of deleted documents are answered in any case, so that these can be read alone.
N-grams travel as sorted hashes of as many bytes as keep the chance that an n-gram shares
its hash below 1e-6 at the corpus's size. Frequent n-grams cost one entry per block, so
none is hot.

Only the held-out statistics, binned, reach the driver; their size depends on the bins.

A null text is empty: it has one token, its end. Rows are independent, also when they share
an id; a null id counts as an empty one. Without training documents every token has the
uniform probability; without held-out counts the weights are fixed ones.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtrail.llm.shared import small_batches, written
from watchtrail.llm.text import SMALL_BLOCK, blocks, scramble, word_hashes

BLOCK_BYTES = 8_000_000
RANGE_ENTRIES = 1_000_000
LEAST_BLOCKS = 24
#: Bits of a hash beyond those that number the tokens of the corpus.
SPARE_BITS = 20
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
CONTEXT = np.uint64(0xD1342543DE82EF95)
BUCKETS = 24
#: Bins per power of ten of the held-out probabilities; 0 stands for probability 0.
BINS = 25
PASSES = 40
DEFAULT = (0.4, 0.5, 0.1)
SMOOTH = 0.1
EVALUATED, DELETED, KEPT = 0, 1, 2


class Tokens(NamedTuple):
    words: np.ndarray
    before: np.ndarray
    bounds: np.ndarray
    bits: int


def hash_bits(tokens: float) -> int:
    """Bits of a hash, in whole bytes, for a corpus of so many tokens."""
    return min(64, 8 * math.ceil((math.log2(max(2.0, tokens)) + SPARE_BITS) / 8))


def tokenized(texts: list[str | None], bits: int) -> Tokens:
    """Hashes of all tokens (words of the lower-cased texts and an end each) and of the tokens before."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    parts, bounds = [np.empty(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)]
    for first, end in blocks(data, SMALL_BLOCK):
        own, at = word_hashes(data[first:end])
        parts.append(own)
        bounds.append(at[1:] + bounds[-1][-1])
    hashes, bounds = np.concatenate(parts), np.concatenate(bounds)
    words = np.insert(hashes, bounds[1:], END) >> np.uint64(64 - bits)
    bounds = bounds + np.arange(len(bounds))
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[bounds[:-1]] = START >> np.uint64(64 - bits)
    return Tokens(words, before, bounds, bits)


def bigrams(tokens: Tokens) -> np.ndarray:
    return scramble(tokens.before * CONTEXT + tokens.words) >> np.uint64(64 - tokens.bits)


def own_counts(grams: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams in order, places of the tokens among them, counts in kept, in deleted documents)."""
    distinct, place = np.unique(grams, return_inverse=True)
    counts = [np.bincount(place[use == u], minlength=len(distinct)) for u in (KEPT, DELETED)]
    return distinct, place, *counts


def to_planes(numbers: np.ndarray, width: int) -> bytes:
    """The bytes of little-endian numbers, all first bytes first: sorted numbers compress well so."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    found = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    found[:, :width] = planes.T
    return found.view("<u8").ravel().astype(np.uint64)


#: Bytes of a count.
COUNT = 5
#: Tokens that are weighed at a time.
SLICE = 1 << 16


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    return docs.withColumn("block", place)


def requests(docs: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """(n, range, block, n-grams, kept and deleted counts) of ``docs`` (text, use, block).

    A block is read as a whole, so it sends one row to each range of hashes.
    """
    shift, widths = np.uint64(bits - range_bits), (bits // 8, COUNT, COUNT)

    def sent(rows: pd.DataFrame) -> pd.DataFrame:
        block, found = int(rows["block"].iloc[0]), []
        tokens = tokenized(rows["text"].tolist(), bits)
        use = np.repeat(rows["use"].to_numpy(), np.diff(tokens.bounds))
        for n, grams in ((1, tokens.words), (2, bigrams(tokens))):
            distinct, _, kept, deleted = own_counts(grams, use)
            ranges = (distinct >> shift).astype(np.int64)
            for at in np.split(np.arange(len(distinct)), np.flatnonzero(np.diff(ranges)) + 1):
                planes = [to_planes(x[at], w) for x, w in zip((distinct, kept, deleted), widths, strict=True)]
                found.append((n, int(ranges[at[0]]), block, *planes))
        return pd.DataFrame(found, columns=["n", "range", "block", "grams", "kept", "deleted"])

    rows = docs.select("text", "use", "block").groupBy("block")
    return rows.applyInPandas(sent, "n int, range int, block int, grams binary, kept binary, deleted binary")


def answers(rows: DataFrame, bits: int) -> DataFrame:
    """Totals of the n-grams of ``requests``, by range: (n, block, n-grams, counts, held_out).

    A block is told the counts in all training documents where they differ from its own,
    and, for n-grams of its deleted documents, the counts in kept ones (``held_out``). The
    row of block -1 has the range's sums.
    """
    width = bits // 8

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        columns = (("grams", width), ("kept", COUNT), ("deleted", COUNT))
        parts = [[from_planes(d, w) for d in rows[c]] for c, w in columns]
        grams, kept, deleted = map(np.concatenate, parts)
        block = np.repeat(rows["block"].to_numpy(), [len(g) for g in parts[0]])
        order = np.lexsort((block, grams))
        grams, block, kept, deleted = grams[order], block[order], kept[order], deleted[order]
        new = np.concatenate([[True], grams[1:] != grams[:-1]])
        starts = np.flatnonzero(new)
        totals = [np.add.reduceat(x, starts) for x in (kept, deleted)]
        all_kept, all_deleted = (np.repeat(t, np.diff(np.append(starts, len(grams)))) for t in totals)
        n = int(rows["n"].iloc[0])
        sums = [totals[0].sum(), totals[1].sum(), (totals[0] > 0).sum(), (totals[0] + totals[1] > 0).sum()]
        found = [(n, -1, np.array(sums, dtype="<i8").tobytes(), b"", False)]
        differs = (all_kept != kept) | (all_deleted != deleted)
        for chosen, counts, held_out in ((differs, all_kept + all_deleted, False), (deleted > 0, all_kept, True)):
            rest = np.flatnonzero(chosen)
            rest = rest[np.lexsort((grams[rest], block[rest]))]
            for at in np.split(rest, np.flatnonzero(np.diff(block[rest])) + 1):
                if len(at):
                    found.append((n, int(block[at[0]]), to_planes(grams[at], width), to_planes(counts[at], COUNT), held_out))
        return pd.DataFrame(found, columns=["n", "block", "grams", "counts", "held_out"])

    kinds = "n int, block int, grams binary, counts binary, held_out boolean"
    return rows.groupBy("n", "range").applyInPandas(answer, kinds)


class Totals(NamedTuple):
    kept: int
    deleted: int
    kept_types: int
    types: int


def looked_up(grams: np.ndarray, counts: np.ndarray | None, found: pd.DataFrame, bits: int) -> tuple[np.ndarray, ...]:
    """(distinct n-grams, their counts, counts of the tokens): own counts of some tokens, or as answered."""
    distinct, place = np.unique(grams, return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    if counts is not None:
        total += np.bincount(place[counts], minlength=len(distinct))
    for hashes, numbers in found[["grams", "counts"]].itertuples(index=False):
        total[np.searchsorted(distinct, from_planes(hashes, bits // 8))] = from_planes(numbers, COUNT).astype(np.int64)
    return distinct, total, total[place]


def estimates(tokens: Tokens, own: np.ndarray | None, found: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Per token: counts of the bigram, the context and the word.

    ``own`` marks the tokens that count in this block; None if all counts are answered.
    """
    two = looked_up(bigrams(tokens), own, found[found["n"] == 2], tokens.bits)[-1]
    words, counts, one = looked_up(tokens.words, own, found[found["n"] == 1], tokens.bits)
    before = tokens.before.copy()
    before[tokens.bounds[:-1]] = END >> np.uint64(64 - tokens.bits)  # a start for every end
    context = counts[np.searchsorted(words, before)]
    return two, context, one


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never met, then one bucket per power of two."""
    return np.minimum(np.ceil(np.log2(context + 1.0)).astype(np.int64), BUCKETS - 1)


def chances(
    two: np.ndarray, context: np.ndarray, one: np.ndarray, total: int, weights: np.ndarray, uniform: float
) -> np.ndarray:
    """The mixed probability of each token from its counts, a slice of tokens at a time."""
    chance = np.empty(len(one))
    for at in range(0, len(one), SLICE):
        part = slice(at, at + SLICE)
        mix = weights[bucket(context[part])]
        chance[part] = mix[:, 0] * two[part] / np.maximum(context[part], 1) + mix[:, 1] * one[part] / max(1, total) + mix[:, 2] * uniform
    return chance


def binned(part: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(part > 0, 1 + np.round(-BINS * np.log10(part / whole)), 0).astype(np.int64)


def _grouped(docs: DataFrame, found: DataFrame):
    return docs.groupBy("block").cogroup(found.groupBy("block"))


def held_out_counts(docs: DataFrame, found: DataFrame, sums: Totals, bits: int) -> DataFrame:
    """(bucket, bigram bin, word bin, tokens) over the deleted documents, seen through the kept ones."""

    def counted(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"bucket": [], "two": [], "one": [], "tokens": []})
        tokens = tokenized(rows["text"].tolist(), bits)
        two, context, one = estimates(tokens, None, found)
        bins = pd.DataFrame({"bucket": bucket(context), "two": binned(two, context), "one": binned(one, max(1, sums.kept))})
        return bins.groupby(["bucket", "two", "one"]).size().reset_index(name="tokens")

    kinds = "bucket long, two long, one long, tokens long"
    counts = _grouped(docs, found).applyInPandas(counted, kinds)
    return counts.groupBy("bucket", "two", "one").agg(F.sum("tokens").alias("tokens"))


def learn_weights(counts: pd.DataFrame, uniform: float) -> np.ndarray:
    """(bucket, (bigram, word, uniform)) weights that make the held-out counts likeliest."""
    probability = lambda b: np.where(b > 0, 10.0 ** ((1 - b) / BINS), 0.0)
    parts = np.stack([probability(counts["two"]), probability(counts["one"]), np.full(len(counts), uniform)], axis=1)
    tokens, of = counts["tokens"].to_numpy(dtype=float), counts["bucket"].to_numpy(dtype=int)

    def learn(rows: np.ndarray, start: np.ndarray, prior: float) -> np.ndarray:
        weights = start
        for _ in range(PASSES):
            shares = parts[rows] * weights
            shares /= shares.sum(axis=1, keepdims=True)
            gained = tokens[rows] @ shares + prior * start
            weights = gained / gained.sum()
        return weights

    start = np.array(DEFAULT)
    pooled = learn(np.arange(len(counts)), start, 1.0) if len(counts) else start
    weights = np.stack([learn(np.flatnonzero(of == b), pooled, 10.0) for b in range(BUCKETS)])
    weights[0, 1:] += weights[0, 0] * weights[0, 1:] / weights[0, 1:].sum()
    weights[0, 0] = 0.0
    return weights


def scored(docs: DataFrame, found: DataFrame, sums: Totals, weights: np.ndarray, uniform: float, bits: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    total = sums.kept + sums.deleted
    floor = total + SMOOTH * (sums.types + 1)

    def score(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"doc_id": [], "use": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
        tokens = tokenized(rows["text"].tolist(), bits)
        taught = np.repeat(rows["use"].to_numpy() != EVALUATED, np.diff(tokens.bounds))
        two, context, one = estimates(tokens, taught, found)
        chance = chances(two, context, one, total, shared.value, uniform)
        add = lambda x: np.add.reduceat(x, tokens.bounds[:-1])
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].to_numpy(),
                "use": rows["use"].to_numpy(),
                "n_tokens": np.diff(tokens.bounds),
                "n_known": add((one > 0).astype(np.int64)),
                "base_score": add(np.log10((one + SMOOTH) / floor)),
                "score": add(np.log10(chance)),
            }
        )

    kinds = "doc_id long, use int, n_tokens long, n_known long, base_score double, score double"
    return _grouped(docs, found).applyInPandas(score, kinds)


def model_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, use, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (doc_id, text, use).

    ``use`` is EVALUATED for documents that teach nothing, DELETED for training documents
    that teach the weights, KEPT for the others.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    total = (size[0] or 0) + size[1]
    blocks = max(LEAST_BLOCKS, math.ceil(total / BLOCK_BYTES))
    bits = hash_bits(total / 6)
    range_bits = max(4, math.ceil(math.log2(max(1, total / 6 / RANGE_ENTRIES))))
    docs = dealt(docs.select(F.col("doc_id").cast("long"), "text", F.col("use").cast("int").alias("use")), blocks)
    found = written(answers(requests(docs, bits, range_bits), bits), "answers")
    # One row per range of hashes.
    each = [np.frombuffer(r["grams"], dtype="<i8") for r in found.filter("block < 0 and n = 1").select("grams").collect()]
    sums = Totals(*map(int, np.sum(each, axis=0))) if each else Totals(0, 0, 0, 0)
    found = found.filter("block >= 0")
    deleted = docs.filter(F.col("use") == DELETED)
    counts = written(held_out_counts(deleted, found.filter("held_out"), sums, bits), "held_out").toPandas()
    weights = learn_weights(counts, 1 / (sums.kept_types + 1))
    if not sums.types:
        weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    result = scored(docs, found.filter("not held_out"), sums, weights, 1 / (sums.types + 1), bits)
    return result.withColumn("train_tokens", F.lit(sums.kept + sums.deleted).cast("long"))
