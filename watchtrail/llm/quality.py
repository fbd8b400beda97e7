"""Quality classifier: support vectors over n-gram indicators scaled by Naive Bayes ratios.

A document's indicators are its byte n-grams (1 to 4 bytes) and its trigrams of word
shapes (case, final mark, whether the word repeats the one before), hashed into a fixed
number of features. Over the labelled sample the smoothed counts of both classes give each
feature a log-count ratio; the scaled indicators, divided by the root of their number, feed
a linear model with hinge loss, fitted by dual coordinate descent. A fifth of the sample is
kept from the fit to turn margins into probabilities.

The fit reads at most ``SAMPLE`` labelled rows, drawn by hash of the id; every text is
scored whole, in the same way, on the executors. Features are a fixed number, so is the
model that tasks receive.

Nulls: a null text is empty and scores by the bias alone; a null or absent label teaches
nothing; of differing labels of one id the smallest counts. With one class among the labels
every score is that class; without labels every score is 0.5. Ids may repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtrail.llm.text import SMALL_BLOCK, SPACE, blocks, scramble, word_hashes

FEATURES = 1 << 17
SAMPLE = 8_000
LONGEST = 4
PASSES = 12
COST = 1.0
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
UPPER, LOWER, DIGIT = (
    np.isin(np.arange(256), np.arange(*span)) for span in ((65, 91), (97, 123), (48, 58))
)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def _shapes(data: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A small number per word: its first, second and last byte's kinds, and whether it repeats the one before."""
    space = SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    kinds = np.full(256, 3, dtype=np.uint32)
    kinds[UPPER], kinds[LOWER], kinds[DIGIT] = 0, 1, 2
    kinds[128:] = 4
    second = np.minimum(starts + 1, ends - 1)
    repeats = np.concatenate([[False], hashes[1:] == hashes[:-1]])[: len(hashes)]
    return ((kinds[data[starts]] * 5 + kinds[data[second]]) * 5 + kinds[data[ends - 1]]) * 2 + repeats


def indicators(texts: list[bytes], features: int = FEATURES) -> list[np.ndarray]:
    """The sorted feature numbers of each text."""
    shift = np.uint32(32 - features.bit_length() + 1)
    found, mark = [], np.zeros(features, dtype=bool)
    for first, end in blocks(texts, SMALL_BLOCK):
        group = texts[first:end]
        data = np.frombuffer(b" " + b" ".join(group) + b" ", dtype=np.uint8)
        hashes, bounds = word_hashes(group)
        shapes = _shapes(data, hashes).astype(np.uint32)
        wide = data.astype(np.uint32) + np.uint32(1)
        grams = [wide * np.uint32(MULTIPLIERS[0])]
        for n in range(1, LONGEST):
            grams.append((grams[-1][:-1] ^ wide[n:]) * np.uint32(MULTIPLIERS[n]))
        grams = [(g ^ (g >> np.uint32(15))) * np.uint32(MULTIPLIERS[1]) >> shift for g in grams]
        at = 1
        for i, text in enumerate(group):
            for n, gram in enumerate(grams):
                mark[gram[at : at + max(0, len(text) - n)]] = True
            own = shapes[bounds[i] : bounds[i + 1]].astype(np.uint64)
            if len(own) > 2:
                triples = (own[:-2] << np.uint64(20)) | (own[1:-1] << np.uint64(10)) | own[2:]
                mark[scramble(triples + np.uint64(1 << 40)) >> np.uint64(65 - features.bit_length())] = True
            at += len(text) + 1
            active = np.flatnonzero(mark)
            mark[active] = False
            found.append(active.astype(np.int32))
    return found


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, features: int, smooth: float = 1.0) -> np.ndarray:
    ratios = np.zeros(features)
    for label, sign in ((1, 1.0), (0, -1.0)):
        counts = np.full(features, smooth)
        for i in np.flatnonzero(labels == label):
            counts[rows[i]] += 1
        ratios += sign * np.log(counts / counts.sum())
    return ratios


def fit_hinge(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray, cost: np.ndarray, passes: int) -> np.ndarray:
    """Weights (the last is the bias) of min |w|^2 / 2 + sum cost * hinge, by dual coordinate descent."""
    weights, alpha = np.zeros(len(ratios) + 1), np.zeros(len(rows))
    values = [(ratios[r] / math.sqrt(max(1, len(r)))).astype(np.float32) for r in rows]
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + weights[-1]) - 1.0
            step = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if step != alpha[i]:
                change = (step - alpha[i]) * signs[i]
                weights[rows[i]] += change * values[i]
                weights[-1] += change
                alpha[i] = step
    return weights


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a * margin + b))) fits the labels; a is positive."""
    positive = labels.sum()
    goal = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        change = np.linalg.solve(hessian, x.T @ (goal - p) - 1e-6 * np.array([a, b]))
        a, b = a + float(np.clip(change[0], -2, 2)), b + float(np.clip(change[1], -2, 2))
    return (a, b) if a > 0 else (1.0, 0.0)


def margins(rows: list[np.ndarray], scaled: np.ndarray) -> np.ndarray:
    return np.array([scaled[r].sum() / math.sqrt(max(1, len(r))) for r in rows]) + scaled[-1]


def fit(texts: list[bytes], labels: np.ndarray, features: int = FEATURES) -> tuple[np.ndarray, float, float]:
    """(one weight per feature and the bias, sigmoid's slope, sigmoid's shift)."""
    if len(set(labels.tolist())) < 2:
        sure = 0.0 if not len(labels) else 30.0 if labels[0] == 1 else -30.0
        return np.zeros(features + 1), 1.0, sure
    rows = indicators(texts, features)
    kept = np.arange(len(rows)) % 5 == 0
    learn = [r for r, k in zip(rows, kept, strict=True) if not k]
    if len(set(labels[~kept].tolist())) < 2 or len(set(labels[kept].tolist())) < 2:
        learn, kept = rows, np.zeros(len(rows), dtype=bool)
    own = labels[~kept]
    ratios = log_count_ratios(learn, own, features)
    share = own.mean()
    cost = COST * np.where(own == 1, 0.5 / share, 0.5 / (1 - share))
    weights = fit_hinge(learn, np.where(own == 1, 1.0, -1.0), ratios, cost, PASSES)
    scaled = np.append(weights[:-1] * ratios, weights[-1])
    check = [r for r, k in zip(rows, kept, strict=True) if k] or rows
    return scaled, *fit_sigmoid(margins(check, scaled), labels[kept] if kept.any() else labels)


def labelled_sample(docs: DataFrame, labels: DataFrame, learnable: Column, size: int = SAMPLE) -> DataFrame:
    """(id, text, label) of at most ``size`` labelled documents, drawn by hash of the id."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(learnable)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    # Bounded by ``size``, whatever the number of labels.
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(size)


def fitted(sample: DataFrame) -> tuple[np.ndarray, float, float]:
    """``fit`` of a bounded sample (text, label), in one task; the model comes to the driver."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        labels: list[int] = []
        for batch in batches:
            texts += [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            labels += batch.column("label").to_pylist()
        scaled, slope, shift = fit(texts, np.array(labels, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([scaled.tobytes()]), pa.array([slope]), pa.array([shift])], ["w", "slope", "shift"])

    row = sample.select("text", "label").coalesce(1).mapInArrow(learn, "w binary, slope double, shift double").first()
    if row is None:  # an empty sample may have no partition
        return fit([], np.array([], dtype=np.int64))
    return np.frombuffer(row["w"]), row["slope"], row["shift"]


def score(docs: DataFrame, labels: DataFrame, learnable: Column, *, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text) with ``score``, the probability of label 1.

    ``learnable`` says of a label's ``doc_id`` whether it may be learnt from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(labelled_sample(docs, labels, learnable, sample)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, slope, shift = shared.value
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            found: list[float] = []
            for at in range(0, len(texts), 500):
                m = margins(indicators(texts[at : at + 500], len(scaled) - 1), scaled)
                found.extend(1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30))))
            yield batch.append_column("score", pa.array(found, pa.float64()))

    docs = docs.drop("score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scored, f"{fields}, score double")
