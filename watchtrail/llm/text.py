"""Words of whole texts as 64-bit hashes, computed for many texts at a time in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: ASCII white space; a word is a run of other bytes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Texts are joined up to about this many bytes; a longer text is a block of its own.
BLOCK = 1 << 20
#: The same where the work needs many times a block's bytes, and workers share an executor's memory.
SMALL_BLOCK = 1 << 18


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for base in (BASE, INVERSE):
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        found.append(np.cumprod(factors, dtype=np.uint64))
    return tuple(found)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, position of each text's first word plus one end)."""
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = SPACE[joined]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(12, int(len(joined)).bit_length())
    power, inverse = _powers(size)
    sums = np.empty(len(joined) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((joined + np.uint64(1)) * power[: len(joined)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
    return scramble(hashes), np.searchsorted(starts, begins)


def blocks(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)
