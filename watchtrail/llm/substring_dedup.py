"""Removal of words covered by repeated windows of words, by super-k-mer partitioning.

A window is ``WIDTH`` consecutive words of one text. Its minimiser is the smallest hash of the
runs of ``RUN`` words inside it, so a window's content decides its minimiser and equal windows
meet in the same bucket. Consecutive windows sharing a minimiser travel together as one packed
string of words (a super-k-mer), so a text is sent about three times instead of ``WIDTH``
times. Identical super-k-mers of a block are sent once with their number of copies, and a
bucket collapses copies again as they arrive. In its bucket each super-k-mer is cut back into
windows, which are sorted by hash and, where hashes are equal, compared byte by byte, so
counts are exact. A bucket holding more than ``LIMIT`` windows is split by window hash; a
super-k-mer then goes to each part one of its windows belongs to.

A first pass writes only where each super-k-mer lies (key, start, minimiser, windows and a
64-bit hash of its packed string); bucket sizes come from it. A window that occurs twice has a
minimiser met in two super-k-mers, or lies twice in one, so only such super-k-mers are packed
and sent: a bitmap of bounded size tells tasks the minimisers met more than once. Runs of repeated windows go back
to the texts by a join on (minimiser, packed hash), and each text drops the words they cover.
Packed strings are shuffled once and never written. The hot-bucket list sent to tasks is
checked against ``HOT_MAX``; nothing but it and the bitmap is collected. Per-text work is NumPy in Arrow batches.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from watchtrail.session import checkpoint_dir
from watchtrail.llm.shared import bitmap, marked, written
from watchtrail.llm.text import SPACE, blocks, scramble, word_hashes

#: Words per window (the contract), words per minimiser run, most windows a super-k-mer packs.
WIDTH, RUN, PACK = 35, 8, 64
#: Windows a bucket may hold before it is split by window hash.
LIMIT = 200_000
GAPS = re.compile(rb"[\x20\x09-\x0D]+")
BASE = np.uint64(0x9E3779B97F4A7C15)

OCCURRENCES = "k1 long, k2 long, start long, minimiser long, n_win long, p long"
PACKED = "minimiser long, part long, parts long, p long, packed binary, copies long"
RUNS = "minimiser long, p long, first long, last long"
#: Most hot minimisers whose part counts are sent to every task; beyond it ``LIMIT`` doubles.
HOT_MAX = 1_000_000
#: Most bits of the bitmap of minimisers met more than once, and bits it has per minimiser up to there.
BITS, EACH = 1 << 28, 16
KEPT = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])


def normal(text: str | None) -> bytes:
    """The text's words joined by one space, as UTF-8."""
    return GAPS.sub(b" ", (text or "").encode()).strip(b" ")


def spans(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where each word of a space-joined string starts and ends."""
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[np.frombuffer(b" " + packed + b" ", dtype=np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(width - 1, BASE, np.uint64)]), dtype=np.uint64)
    total = np.zeros(n, np.uint64)
    for t in range(width):
        total += hashes[t : t + n] * powers[t]
    return scramble(total)


def block_super_kmers(texts: list[bytes]) -> dict[str, np.ndarray | list]:
    """Super-k-mers of normalised texts hashed together (a block of about 1 MB).

    Returns arrays ``text`` (index in ``texts``), ``start`` (first window's word), ``n_win``,
    ``minimiser``, the ``packed`` strings and the ``whole`` hash of every window by word.
    """
    hashes, firsts_of = word_hashes(texts)
    joined = b" ".join(texts)
    begins, ends = spans(joined)
    count = len(hashes) - WIDTH + 1
    empty = {"text": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "n_win": np.zeros(0, np.int64),
             "minimiser": np.zeros(0, np.int64), "packed": [], "whole": np.zeros(0, np.int64)}
    if count <= 0:
        return empty
    runs = rolling(hashes, RUN)
    least = np.lib.stride_tricks.sliding_window_view(runs, WIDTH - RUN + 1).min(axis=1).view(np.int64)
    whole = rolling(hashes, WIDTH).view(np.int64)
    owner = np.searchsorted(firsts_of, np.arange(count), side="right") - 1
    valid = np.arange(count) + WIDTH <= firsts_of[owner + 1]
    index = np.flatnonzero(valid)
    if not len(index):
        return empty
    head = np.ones(len(index), dtype=bool)
    head[1:] = (owner[index[1:]] != owner[index[:-1]]) | (least[index[1:]] != least[index[:-1]])
    run_first = np.maximum.accumulate(np.where(head, np.arange(len(index)), 0))
    head |= (np.arange(len(index)) - run_first) % PACK == 0
    at = np.flatnonzero(head)
    n_win = np.diff(np.append(at, len(index)))
    first = index[at]
    last_word = first + n_win - 1 + WIDTH - 1
    packed = [joined[a:b] for a, b in zip(begins[first].tolist(), ends[last_word].tolist())]
    return {"text": owner[first], "start": first - firsts_of[owner[first]], "n_win": n_win,
            "minimiser": least[first], "packed": packed, "whole": whole, "first": first}


def _occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k1, k2, start, minimiser, n_win, p) of every super-k-mer; no packed strings."""
    for batch in batches:
        texts = [normal(t) for t in batch["text"]]
        k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
        for lo, hi in blocks(texts):
            found = block_super_kmers(texts[lo:hi])
            rows = lo + found["text"]
            yield pd.DataFrame({
                "k1": k1[rows], "k2": k2[rows], "start": found["start"], "minimiser": found["minimiser"],
                "n_win": found["n_win"], "p": np.array([xxhash.xxh3_64_intdigest(b) for b in found["packed"]], dtype=np.uint64).view(np.int64),
            })


def twice(hashes: np.ndarray) -> np.ndarray:
    """For each of ``hashes`` whether it is among them more than once."""
    order = np.argsort(hashes)
    equal = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    found = np.zeros(len(hashes), dtype=bool)
    found[order[equal]] = found[order[equal + 1]] = True
    return found


def may_repeat(found: dict[str, np.ndarray | list], met: np.ndarray) -> np.ndarray:
    """Places of a block's super-k-mers that may hold a repeated window.

    ``met`` is the bitmap of minimisers that more than one super-k-mer has.
    """
    if not len(found["text"]):
        return np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(twice(found["whole"]))])
    inside = upto[found["first"] + found["n_win"]] > upto[found["first"]]
    return np.flatnonzero(inside | marked(met, found["minimiser"].view(np.uint64)))


def _packed(hot: dict[int, int], met: Broadcast):
    """Super-k-mers that may repeat, with their bucket part; identical ones of a block are sent once, counted."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [normal(t) for t in batch["text"]]
            for lo, hi in blocks(texts):
                found = block_super_kmers(texts[lo:hi])
                rows = {"minimiser": [], "part": [], "parts": [], "p": [], "packed": []}
                for i in may_repeat(found, met.value).tolist():
                    m, packed = int(found["minimiser"][i]), found["packed"][i]
                    n = hot.get(m, 1)
                    p = xxhash.xxh3_64_intdigest(packed)
                    if n == 1:
                        chosen = [0]
                    else:
                        a = int(found["first"][i])
                        chosen = np.unique(found["whole"][a : a + int(found["n_win"][i])] % n).tolist()
                    for part in chosen:
                        rows["minimiser"].append(m)
                        rows["part"].append(part)
                        rows["parts"].append(n)
                        rows["p"].append(p)
                        rows["packed"].append(packed)
                frame = pd.DataFrame(rows)
                frame["p"] = np.asarray(rows["p"], dtype=np.uint64).view(np.int64)
                if len(frame):
                    frame = frame.groupby(["minimiser", "part", "parts", "p", "packed"], sort=False).size().reset_index(name="copies")
                else:
                    frame["copies"] = np.zeros(0, np.int64)
                yield frame

    return emit


def window_hashes(packed: list[bytes]) -> list[np.ndarray]:
    """The hash of every window of each space-joined string, as :func:`block_super_kmers` makes them."""
    found = []
    for lo, hi in blocks(packed):
        hashes, firsts_of = word_hashes(packed[lo:hi])
        whole = rolling(hashes, WIDTH).view(np.int64)
        found += [whole[a : b - WIDTH + 1] for a, b in zip(firsts_of[:-1].tolist(), firsts_of[1:].tolist())]
    return found


def repeated_runs(rows: pd.DataFrame) -> list[tuple]:
    """(minimiser, p, first, last) runs of windows seen twice or more, counted exactly.

    ``rows`` holds whole buckets: every super-k-mer sharing a (minimiser, part) is present,
    each with its number of copies. Equal hashes are confirmed on the bytes of the windows.
    """
    rows = rows.groupby(["minimiser", "part", "parts", "p", "packed"], sort=False)["copies"].sum().reset_index()
    packed = rows["packed"].tolist()
    where, hashes, weights = [], [], []
    for r, (found, parts, part, copies) in enumerate(zip(window_hashes(packed), rows["parts"], rows["part"], rows["copies"])):
        index = np.arange(len(found)) if parts == 1 else np.flatnonzero(found % parts == part)
        where.append(np.stack([np.full(len(index), r), index], axis=1))
        hashes.append(found[index])
        weights.append(np.full(len(index), copies, dtype=np.int64))
    if not where:
        return []
    where, hashes, weights = np.concatenate(where), np.concatenate(hashes), np.concatenate(weights)
    if not len(hashes):
        return []
    order = np.argsort(hashes, kind="stable")
    hashes, where, weights = hashes[order], where[order], weights[order]
    breaks = np.flatnonzero(hashes[1:] != hashes[:-1]) + 1
    lo, hi = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(hashes)]])
    totals = np.add.reduceat(weights, lo)
    offsets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    repeated: list[tuple[int, int]] = []
    for a, b, total in zip(lo, hi, totals):
        if total < 2:
            continue
        if b - a == 1:
            repeated.append(tuple(where[a]))
            continue
        by_text: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        counts: dict[bytes, int] = defaultdict(int)
        for (r, j), w in zip(where[a:b], weights[a:b]):
            if r not in offsets:
                offsets[r] = spans(packed[r])
            firsts, lasts = offsets[r]
            body = packed[r][firsts[j] : lasts[j + WIDTH - 1]]
            by_text[body].append((r, j))
            counts[body] += int(w)
        repeated += [place for body, places in by_text.items() if counts[body] >= 2 for place in places]
    found = []
    marked = defaultdict(list)
    for r, j in repeated:
        marked[int(r)].append(int(j))
    for r, js in marked.items():
        js = np.unique(js)
        cut = np.flatnonzero(np.diff(js) > 1) + 1
        head = (int(rows["minimiser"].iat[r]), int(rows["p"].iat[r]))
        found += [(*head, int(g[0]), int(g[-1])) for g in np.split(js, cut)]
    return found


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole buckets from rows sorted by (minimiser, part): the last bucket of a batch waits.

    Waiting rows are collapsed to distinct super-k-mers with summed copies, so copies sent
    from many tasks take the memory of one.
    """
    columns = [c.split()[0] for c in RUNS.split(", ")]
    waiting = None
    for batch in batches:
        rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows["minimiser"].iat[-1], rows["part"].iat[-1])
        tail = (rows["minimiser"] == last[0]) & (rows["part"] == last[1])
        waiting = rows[tail].groupby(["minimiser", "part", "parts", "p", "packed"], sort=False)["copies"].sum().reset_index()
        ready = rows[~tail].reset_index(drop=True)
        if len(ready):
            yield pd.DataFrame(repeated_runs(ready), columns=columns)
    if waiting is not None and len(waiting):
        yield pd.DataFrame(repeated_runs(waiting), columns=columns)


def _kept(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found in zip(texts, ranges):
        body = normal(text)
        words = body.split(b" ") if body else []
        if found is None or len(found) == 0:
            rows.append((len(words), 0, hashlib.sha256(body).hexdigest()))
            continue
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        for s, e in found if found is not None else []:
            cover[s] += 1
            cover[e] -= 1
        keep = np.cumsum(cover)[: len(words)] == 0
        kept = b" ".join(w for w, k in zip(words, keep) if k)
        rows.append((len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=KEPT.fieldNames())


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row with ``n_words``, ``n_removed`` and ``kept_sha256`` of its text's kept words.

    A word is removed when a window of ``WIDTH`` words covering it occurs anywhere else too,
    same text included; windows are judged on the input. Words are maximal runs of bytes other
    than ASCII white space, kept unchanged and joined by one space. A null text has no words;
    a text of fewer than ``WIDTH`` words loses none. Repeated rows are two occurrences, so
    their windows repeat. Added columns replace input columns of the same names; the rest stay.
    Rows are told apart by two hashes of (key, text); equal rows get equal results.
    """
    spark = docs.sparkSession
    names = {"k1": "_k1", "k2": "_k2", "ranges": "_ranges"}
    while set(names.values()) & set(docs.columns):
        names = {k: v + "_" for k, v in names.items()}
    keyed = docs.withColumns({
        names["k1"]: F.xxhash64(F.col(key), F.col(text)),
        names["k2"]: F.xxhash64(F.lit("second"), F.col(key), F.col(text)),
    })
    source = keyed.select(F.col(names["k1"]).alias("k1"), F.col(names["k2"]).alias("k2"), F.col(text).alias("text"))
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}/occurrences"
    source.mapInPandas(_occurrences, OCCURRENCES).write.option("compression", "zstd").parquet(folder)
    places = spark.read.schema(OCCURRENCES).parquet(folder)
    sizes = places.groupBy("minimiser").agg(F.sum("n_win").alias("windows"), F.count(F.lit(1)).alias("n"))
    repeated = written(sizes.filter("n > 1").select("minimiser", "windows"), "minimisers")
    met = spark.sparkContext.broadcast(bitmap(repeated, "minimiser", min(BITS, 1 << max(6, (EACH * repeated.count()).bit_length()))))
    limit = LIMIT
    while True:
        hot = repeated.filter(F.col("windows") > limit)
        if hot.count() <= HOT_MAX:
            break
        limit *= 2
    parts = {r.minimiser: int(r.parts) for r in hot.select("minimiser", F.ceil(F.col("windows") / limit).alias("parts")).collect()}
    runs = (
        source.mapInPandas(_packed(parts, met), PACKED)
        .repartition("minimiser", "part")
        .sortWithinPartitions("minimiser", "part", "p")
        .mapInPandas(_count, RUNS)
    )
    found = places.select("k1", "k2", "start", "minimiser", "p").join(runs, ["minimiser", "p"])
    covered = found.groupBy("k1", "k2").agg(
        F.collect_list(F.array(F.col("start") + F.col("first"), F.col("start") + F.col("last") + WIDTH)).alias("ranges")
    )
    covered = written(covered, "covered")
    met.destroy()
    joined = keyed.join(covered.withColumnsRenamed(names), [names["k1"], names["k2"]], "left")
    result = F.pandas_udf(_kept, KEPT)(F.col(text), F.col(names["ranges"]))
    out = "_kept"
    while out in docs.columns:
        out += "_"
    return joined.withColumn(out, result).withColumns(
        {c: F.col(f"{out}.{c}") for c in KEPT.fieldNames()}
    ).drop(out, *names.values())
