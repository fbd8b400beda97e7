"""Fill-in-the-middle rewriting of whole texts; each cut is found through a learned rank index.

A text's tokens are runs of ASCII letters or single other code points. The offsets at which
tokens end, taken in rank order, rise almost linearly, so a few straight segments describe
them: the segments are fitted top-down until no offset lies more than ``ERROR`` code points
from its segment, and what each offset differs from its prediction is stored as a small
residual. A cut after k tokens is the segment's prediction at rank k plus the stored residual
there, which is exact. The index is built and read inside Arrow batches, one text at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Largest distance between an offset and its segment's prediction; residuals fit one byte.
ERROR = 127
#: Fixed values of the format: sentinel strings in output order and the hash input's prefix.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1:"

RESULT = StructType(
    [
        StructField("n", LongType()),
        StructField("form", StringType()),
        StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()),
        StructField("output", StringType()),
    ]
)


def token_ends(text: str) -> np.ndarray:
    """Offsets (code points) of 0 and of the end of each token, in rank order."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    letter = ((points >= 65) & (points <= 90)) | ((points >= 97) & (points <= 122))
    following = np.append(letter[1:], False)
    ends = np.flatnonzero(~letter | ~following) + 1
    return np.concatenate([[0], ends]).astype(np.int64)


def _predict(first: np.ndarray, slope: np.ndarray, start: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    return first + np.rint(slope * (ranks - start)).astype(np.int64)


def fit(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment first ranks, first offsets, slopes, int8 residuals) for sorted offsets.

    A segment runs through its end points; one whose worst residual exceeds ``error`` is
    split at that point. Every residual then fits a signed byte.
    """
    n = len(offsets)
    done: list[tuple[int, int, float]] = []
    pending = [(0, n - 1)]
    residuals = np.zeros(n, dtype=np.int8)
    while pending:
        lo, hi = pending.pop()
        slope = (offsets[hi] - offsets[lo]) / (hi - lo) if hi > lo else 0.0
        ranks = np.arange(lo, hi + 1)
        missed = offsets[lo : hi + 1] - _predict(offsets[lo], slope, lo, ranks)
        worst = int(np.argmax(np.abs(missed)))
        if abs(int(missed[worst])) > error:
            cut = lo + worst
            pending += [(lo, cut), (cut, hi)] if lo < cut < hi else [(lo, lo + (hi - lo) // 2), (lo + (hi - lo) // 2 + 1, hi)]
            continue
        residuals[lo : hi + 1] = missed
        done.append((lo, int(offsets[lo]), slope))
    done.sort()
    starts, firsts, slopes = (np.array(v) for v in zip(*done))
    return starts.astype(np.int64), firsts.astype(np.int64), slopes.astype(np.float64), residuals


def locate(index: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """Exact offsets at the given ranks: a segment's prediction corrected by its residual."""
    starts, firsts, slopes, residuals = index
    at = np.searchsorted(starts, ranks, side="right") - 1
    return _predict(firsts[at], slopes[at], starts[at], ranks) + residuals[ranks]


def rewrite(text: str, h1: int, h2: int, h3: int, h4: int, plain: int, spm: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text and its four hash numbers."""
    offsets = token_ends(text)
    n = len(offsets) - 1
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m = (int(v) for v in locate(fit(offsets), np.array(cuts, dtype=np.int64)))
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    if h4 % 100 < spm:
        return n, "spm", p, m - p, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", p, m - p, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _rewriter(plain: int, spm: int):
    @F.pandas_udf(RESULT)
    def rewrite_texts(texts: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        rows = [rewrite(t or "", *map(int, h), plain, spm) for t, *h in zip(texts, h1, h2, h3, h4)]
        return pd.DataFrame(rows, columns=RESULT.fieldNames()).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return rewrite_texts


def hash_numbers(key: Column, seed: str = SEED) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed`` and the key, as unsigned numbers."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text an output was made from: prefix, middle and suffix put back in order."""
    parts = F.split(output, "<P>|<S>|<M>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", plain: int = 10, spm: int = 20) -> DataFrame:
    """Every row with its text rewritten for fill-in-the-middle training.

    Added columns: ``fim_n`` (tokens), ``fim_form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (code points; null when plain) and ``fim_text``. A null text is empty and
    stays plain; a null key hashes as the empty string; texts holding a sentinel stay plain.
    Repeated rows get equal results. Input columns of the added names are replaced; all other
    columns are kept. The two cuts are hash numbers modulo n + 1, so either part may be empty.
    """
    rewrite_texts = _rewriter(plain, spm)
    name = "_fim"
    while name in docs.columns:
        name += "_"
    found = docs.withColumn(name, rewrite_texts(F.coalesce(F.col(text), F.lit("")), *hash_numbers(F.col(key))))
    added = {
        "fim_n": F.col(f"{name}.n"),
        "fim_form": F.col(f"{name}.form"),
        "prefix_chars": F.col(f"{name}.prefix_chars"),
        "middle_chars": F.col(f"{name}.middle_chars"),
        "fim_text": F.col(f"{name}.output"),
    }
    return found.withColumns(added).drop(name)
