"""Language identification by words first, with backoff to shorter and shorter n-grams.

Words are runs of letters, lower-cased. Every language has relative frequencies of its
words and of the n-grams (4 characters down to 1, with word edges marked) of its words.
A known word costs minus the log of its frequency in each language, with a fixed penalty
where the language lacks it. A word no language knows is scored by its longest n-grams
that are known, averaged. A text's cost per language is the mean over its words; the
cheapest language is predicted.

All texts with a language are counted, on the executors, and every counted word and n-gram
stays in the model, as a written table. Words that make up a stated share of some language
are sent to the workers with their costs in all languages (at most 1 / share words per
language); a text's other words are joined to the table, once per distinct word and text, in rounds
by a hash of the word.
The penalty is above the cost of a single occurrence, however large a language is.

A null text, and a text without a letter, is ``und`` with score 0; so is every text when
nothing was learnt. Null languages teach nothing. Ties go to the first language by code
point. Ids may repeat; further columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtrail.llm.shared import written

#: Words from this share of some language are sent to the workers; the others are joined.
WORD_SHARE = 1e-5
LONGEST = 4
#: Least cost of a word or n-gram in a language that lacks it, in powers of ten.
PENALTY = 7.0
#: Powers of ten by which a word or n-gram that a language lacks costs more than one met once.
ABSENT = 0.3
#: Entries a worker gathers or remembers before it hands them on or starts anew.
MEMORY = 300_000
#: Rounds in which the texts' rare words are joined to the table.
ROUNDS = 2
LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for c in chain.from_iterable(words))


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _rows(counts: dict[str, Counter], names: list[str]) -> pa.RecordBatch:
    langs = [lang for lang, c in counts.items() for _ in c]
    keys = [k for c in counts.values() for k in c]
    numbers = [n for c in counts.values() for n in c.values()]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(numbers, pa.int64())], names)


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over whole texts of ``docs`` (text, lang)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(letters(text))
                if sum(map(len, counts.values())) > MEMORY:
                    yield _rows(counts, ["lang", "word", "n"])
                    counts = {}
        yield _rows(counts, ["lang", "word", "n"])

    known = docs.filter("text is not null and lang is not null").select("text", "lang")
    return known.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, word, n): the n-grams of counted words, each as often as its word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, word, number in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = counts.setdefault(lang, Counter())
                known = own.get
                for n in range(1, longest + 1):
                    for gram in grams(word, n):
                        own[gram] = known(gram, 0) + number
            if sum(map(len, counts.values())) > MEMORY:
                yield _rows(counts, ["lang", "word", "n"])
                counts = {}
        yield _rows(counts, ["lang", "word", "n"])

    found = words.select("lang", "word", "n").mapInArrow(counted, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """What was learnt. ``words`` and ``grams`` have (word, gains), an entry of ``gains`` per language.

    A gain is by how much less than the penalty of its language (and length) a word costs.
    """

    langs: list[str]
    penalties: dict[int, list[float]]
    words: DataFrame | None = None
    grams: DataFrame | None = None
    frequent: tuple[dict[str, int], np.ndarray] | None = None


def _gains(counts: DataFrame, totals: dict[tuple[str, int], int], langs: list[str], penalties: dict[int, list[float]]) -> DataFrame:
    """(word, gains, share): one row per word or n-gram of ``counts`` (lang, word, n), and its largest share."""
    spark = counts.sparkSession
    rows = [(lang, length, langs.index(lang), float(total), penalties[length][langs.index(lang)]) for (lang, length), total in totals.items()]
    known = spark.createDataFrame(rows, "lang string, length int, at int, total double, penalty double")
    each = counts.join(F.broadcast(known), ["lang", "length"])  # one row per language and length
    share = F.col("n") / F.col("total")
    own = F.col("penalty") + F.log10(share)
    sums = [F.coalesce(F.max(F.when(F.col("at") == i, own)), F.lit(0.0)) for i in range(len(langs))]
    return each.groupBy("word").agg(F.array(*sums).alias("gains"), F.max(share).alias("share"))


def learn(docs: DataFrame) -> Model:
    """The model of ``docs`` (text, lang)."""
    words = written(count_words(docs).withColumn("length", F.lit(0)), "words")
    grams = written(count_grams(words).withColumn("length", F.length("word")), "grams")
    sizes = words.groupBy("lang", "length").agg(F.sum("n").alias("total"))
    sizes = sizes.union(grams.groupBy("lang", "length").agg(F.sum("n").alias("total")))
    # One row per language and length.
    totals = {(r["lang"], r["length"]): r["total"] for r in sizes.collect()}
    langs = sorted({lang for lang, _ in totals})
    if not langs:
        return Model([], {})
    penalties = {
        length: [max(PENALTY, math.log10(totals.get((lang, length), 1)) + ABSENT) for lang in langs] for length in range(LONGEST + 1)
    }
    word_gains = written(_gains(words, totals, langs, penalties), "word_gains")
    gram_gains = written(_gains(grams, totals, langs, penalties), "gram_gains")
    # Bounded by the share: at most 1 / share words per language.
    often = word_gains.filter(F.col("share") >= WORD_SHARE).orderBy("word").toArrow()
    table = np.array(often.column("gains").to_pylist(), dtype=np.float64).reshape(-1, len(langs))
    return Model(langs, penalties, word_gains, gram_gains, ({w: i for i, w in enumerate(often.column("word").to_pylist())}, table))


def _parts(docs: DataFrame, model: Model) -> DataFrame:
    """(key, n, sums, rare): per text its words, the sums of its frequent words' gains, and its other words."""
    shared = docs.sparkSession.sparkContext.broadcast(model.frequent)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = shared.value
        place = index.get
        for batch in batches:
            keys, numbers, sums, words_of, counts_of, ends = [], [], [], [], [], [0]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = letters(text)
                if not has_letter(words):
                    continue
                at, often = [], []
                for word, n in Counter(words).items():
                    i = place(word)
                    if i is None:
                        words_of.append(word)
                        counts_of.append(n)
                    else:
                        at.append(i)
                        often.append(n)
                keys.append(key)
                numbers.append(len(words))
                sums.append(np.array(often, dtype=np.float64) @ table[np.array(at, dtype=np.int64)])
                ends.append(len(words_of))
            rare = pa.StructArray.from_arrays([pa.array(words_of, pa.string()), pa.array(counts_of, pa.int64())], ["word", "n"])
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)
            columns = [pa.array(keys, pa.binary()), pa.array(numbers, pa.int64()), pa.array(sums, pa.list_(pa.float64())), rare]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "sums", "rare"])

    return docs.mapInArrow(parts, "key binary, n long, sums array<double>, rare array<struct<word:string,n:long>>")


def _unseen(words: DataFrame, model: Model) -> DataFrame:
    """(word, gains) of words that no language knows: by the mean cost of their longest known n-grams."""
    lengths = F.sequence(F.lit(1), F.lit(LONGEST))
    marked = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def cut(n: Column) -> Column:
        last = F.length(marked) - n + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(n.alias("length"), F.substring(marked, i, n).alias("gram")))

    pieces = words.select(F.col("word").alias("of"), F.explode(F.flatten(F.transform(lengths, cut))).alias("piece"))
    pieces = pieces.select("of", "piece.length", F.col("piece.gram").alias("word"))
    means = [F.avg(F.col("gains")[i]).alias(f"g{i}") for i in range(len(model.langs))]
    found = pieces.join(model.grams.select("word", "gains"), "word").groupBy("of", "length").agg(*means)
    best = found.groupBy(F.col("of").alias("word")).agg(
        F.max_by(F.struct("length", *[f"g{i}" for i in range(len(means))]), "length").alias("best")
    )
    # Penalties of n-grams and of words may differ; a gain is against that of words.
    gains = []
    for i in range(len(means)):
        more = F.element_at(F.array(*[F.lit(model.penalties[0][i] - model.penalties[n][i]) for n in range(1, LONGEST + 1)]), F.col("best.length"))
        gains.append(F.col(f"best.g{i}") + more)
    return best.select("word", F.array(*gains).alias("gains"))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of the best language in 10 ** -cost."""
    docs = docs.drop("lang_pred", "score")
    if not model.langs:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    every = range(len(model.langs))
    key = F.unhex(F.md5(text_col))
    parts = _parts(docs.select(key.alias("key"), F.col(text_col).alias("text")), model)
    # Rows are told apart by a number, which takes less room than a key in what is sent for every rare word.
    parts = written(parts.withColumn("id", F.monotonically_increasing_id()), "parts", "zstd")
    sums = [parts.select("id", *[F.col("sums")[i].alias(f"s{i}") for i in every])]
    add = [F.sum(f"s{i}").alias(f"s{i}") for i in every]
    # The rare words are joined in rounds, each with a share of the words, so that one round's shuffles are held at a time.
    for place in range(ROUNDS):
        mine = F.pmod(F.xxhash64("word"), F.lit(ROUNDS)) == place
        rare = parts.select("id", F.explode("rare").alias("r")).select("id", "r.word", "r.n").filter(mine)
        asked = rare.select("word").distinct().join(model.words.select("word", "gains").filter(mine), "word", "left")
        asked = written(asked, "asked", "zstd")
        gains = asked.filter("gains is not null").unionByName(_unseen(asked.filter("gains is null").select("word"), model))
        gains = written(gains, "gains", "zstd")
        more = rare.join(gains, "word").select("id", *[(F.col("n") * F.col("gains")[i]).alias(f"s{i}") for i in every])
        sums.append(written(more.groupBy("id").agg(*add), "sums"))
    total = reduce(DataFrame.union, sums).groupBy("id").agg(*add)
    total = written(total, "total").join(parts.select("id", "key", "n"), "id")
    # Rounded, so that the order of summing does not decide ties.
    costs = F.array(*[F.round(F.lit(model.penalties[0][i]) - F.col(f"s{i}") / F.col("n"), 9) for i in every])
    # A text that occurs more than once has the same sums, but for the order of summing.
    total = total.groupBy(F.col("key").alias("lang_key")).agg(F.min(costs).alias("costs")).withColumn("least", F.array_min("costs"))
    place = F.array_position("costs", F.col("least")).cast("int")
    odds = F.aggregate("costs", F.lit(0.0), lambda acc, c: acc + F.pow(F.lit(10.0), F.col("least") - c))
    found = total.select("lang_key", F.element_at(F.array(*map(F.lit, model.langs)), place).alias("found_lang"), (1 / odds).alias("found_score"))
    found = written(found, "found")
    # The key is a column of its own, or the join would send whole texts to compare them.
    name = "text_key"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, key)
    joined = keyed.join(found, keyed[name] == found["lang_key"], "left")
    return joined.select(
        *[keyed[c] for c in docs.columns],
        F.coalesce("found_lang", F.lit("und")).alias("lang_pred"),
        F.coalesce("found_score", F.lit(0.0)).alias("score"),
    )
