"""Greedy word-piece token counts by one linear pass per word.

The vocabulary is a trie. Every node has a failure link and a number of tokens: when no
edge fits, the tokens matched so far are popped, and the link leads to the node that holds
the characters not popped yet. Precomputed pop counts make a word's length in tokens a sum
over links; no piece is ever built, and no character is read twice.

Words are runs of non-space bytes of the (lower-cased) text; the last byte of a word carries
the vocabulary's end-of-word mark. A word that pieces cannot cover counts as one unknown token.

A null or empty text has no words and no tokens. Rows are independent: repeated rows and
further columns do not matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Added to the last byte of a word.
END = 256
COUNTS = "n_words long, n_tokens long, n_unknown long"
MEMORY = 500_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_pieces(path: str, mark: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a vocabulary file as symbols: bytes, the last one raised by ``END`` where a word ends."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model.get("added_tokens", [])}
    symbols = byte_symbols()
    found = []
    for piece in model["model"]["vocab"]:
        if piece in special:
            continue
        body = [symbols[c] for c in piece.removesuffix(mark)]
        if piece.endswith(mark) and body:
            body[-1] += END
        found.append(tuple(body))
    return found


class Automaton:
    """Trie of pieces with failure links and popped-token counts; the root is node 0."""

    def __init__(self, pieces: list[tuple[int, ...]]) -> None:
        self.edges: dict[int, int] = {}
        ends, parents = {0: False}, [(0, 0)]
        for piece in pieces:
            node = 0
            for symbol in piece:
                key = node << 10 | symbol
                if (then := self.edges.get(key)) is None:
                    then = self.edges[key] = len(parents)
                    parents.append((node, symbol))
                    ends[then] = False
                node = then
            ends[node] = True
        self.link: list[int] = [-1] * len(parents)
        self.pops = [0] * len(parents)
        depth = [0] * len(parents)
        for node in range(1, len(parents)):
            depth[node] = depth[parents[node][0]] + 1
        for node in sorted(range(1, len(parents)), key=depth.__getitem__):
            if ends[node]:
                self.link[node], self.pops[node] = 0, 1
                continue
            parent, symbol = parents[node]
            back, popped = self.link[parent], self.pops[parent]
            while back >= 0 and (back << 10 | symbol) not in self.edges:
                popped += self.pops[back]
                back = self.link[back]
            if back >= 0:
                self.link[node], self.pops[node] = self.edges[back << 10 | symbol], popped

    def count(self, word: bytes) -> int:
        """Tokens of the word, or -1 if pieces cannot cover it."""
        edges, link, pops = self.edges, self.link, self.pops
        node = total = 0
        for symbol in (*word[:-1], word[-1] + END):
            while (then := edges.get(node << 10 | symbol)) is None:
                total += pops[node]
                node = link[node]
                if node < 0:
                    return -1
            node = then
        while node:
            total += pops[node]
            node = link[node]
            if node < 0:
                return -1
        return total


@lru_cache(maxsize=2)
def _automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(read_pieces(path)), {}


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) of every row. ``path`` is opened on the executors."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = (text or "").lower().encode("utf-8", "surrogatepass").split()
                if len(known) > MEMORY:
                    known.clear()
                for word in set(words).difference(known):
                    known[word] = automaton.count(word)
                found = list(map(known.__getitem__, words))
                unknown = found.count(-1)
                rows.append((len(words), sum(found) + 2 * unknown, unknown))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(counted, f"`{id_col}` {kind}, {COUNTS}")
