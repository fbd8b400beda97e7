"""Mixing sources to target weights by Pareto order sampling.

A source whose target is f times its size takes floor(f) certain copies of each document.
The fraction left is a fixed-size sample: a document with random number u and inclusion
probability p has rank (u / (1 - u)) / (p / (1 - p)), and the lowest ranks are taken until
the source's words are reached.

A source may hold a third of all rows, so no source is ever sorted as a whole. Ranks fall
into cells; the words of each cell are summed, whole cells are taken or left, and only the
documents of the one cell where the target falls are ordered.

Long documents are drawn before short ones (strata by share of the words to draw), and each
stratum makes up for what the ones before it missed, so that a source ends within a short
document of its target where it has short ones. A document longer than the words to draw
comes last: the shortest such one is drawn if the source ends nearer to its target with it.

Nulls: a null text has size 0; null sources are one source, ordered last; a null id draws
like any other. Repeated rows are drawn as rows of their own. An empty table, and sources
without words, take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchtrail.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096
#: Documents above these shares of the words to draw are drawn first, second, and so on.
STRATA = (0.05, 0.01)


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): weighted shares, none above ``most`` times the source's size.

    One row per source. Sources reach their limit in the order of limit over weight; what
    they leave is shared by weight among the others, whose common level is the first one
    that keeps its own source below its limit.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    limited = totals.withColumns({"place": place, "weight": weight, "limit": most * F.col("source_size")})
    order = W.orderBy(F.col("limit") / F.col("weight"), "place")
    spent = F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    levels = limited.withColumn("level", (share * total - spent) / rest).withColumn("at", F.row_number().over(order))
    free = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("at"))
    everything = W.partitionBy(F.lit(0))
    level = F.min_by("level", free).over(everything)
    return levels.withColumn("common", level).select(
        "source",
        "source_size",
        F.coalesce(F.least("limit", F.col("common") * F.col("weight")), F.col("limit")).alias("target"),
    )


def lowest_ranks(docs: DataFrame, room: DataFrame) -> DataFrame:
    """``docs`` (source, size, rank, tie, ...) with ``drawn``: whether the rank falls within the source's room.

    ``room`` has (source, words). The document across the limit is drawn if that ends nearer.
    """
    cells = docs.groupBy("source", "cell").agg(F.sum("size").alias("words_in"))
    upto = F.sum("words_in").over(W.partitionBy("source").orderBy("cell"))
    same = cells["source"].eqNullSafe(room["source"])
    cut = (
        cells.withColumn("upto", upto)
        .join(room, same)
        .filter(
            (F.col("upto") > F.col("words"))
            # The first cell is the cut also where earlier strata have left less than no room.
            & ((F.col("upto") - F.col("words_in") <= F.col("words")) | (F.col("upto") == F.col("words_in")))
        )
        .select(
            cells["source"].alias("of"), F.col("cell").alias("cut"), "words", (F.col("upto") - F.col("words_in")).alias("before")
        )
    )
    cut = written(cut, "cut")
    placed = docs.join(cut, docs["source"].eqNullSafe(cut["of"]), "left")
    # A source without a cut has room for all its documents.
    clear = placed.filter(F.col("cut").isNull() | (F.col("cell") != F.col("cut")))
    clear = clear.withColumn("drawn", F.col("cut").isNull() | (F.col("cell") < F.col("cut")))
    order = W.partitionBy("source").orderBy("rank", "tie", "size").rowsBetween(W.unboundedPreceding, 0)
    across = placed.filter(F.col("cell") == F.col("cut")).withColumn("sum", F.col("before") + F.sum("size").over(order))
    over = F.col("sum") - F.col("words")
    across = across.withColumn("drawn", (over <= 0) | (over < F.col("size") - over)).drop("sum")
    return clear.unionByName(across).select(*docs.columns, "drawn")


def longest_last(undrawn: DataFrame, drawn: DataFrame) -> DataFrame:
    """``undrawn`` documents, longer than their source's room, with ``drawn``: at most one per source.

    Each ends beyond the target, so the shortest ends nearest; it must end nearer than none.
    """
    taken = drawn.filter("drawn").groupBy(F.col("source").alias("of")).agg(F.sum("size").alias("so_far"))
    able = undrawn.filter((F.col("size") > F.col("room")) & (F.col("size") < 2 * F.col("room")))
    best = able.groupBy("source").agg(F.min(F.struct("size", "u", "tie")).alias("best"), F.first("room").alias("words"))
    best = best.join(taken, best["source"].eqNullSafe(taken["of"]), "left").drop("of")
    gap = F.col("words") - F.coalesce("so_far", F.lit(0))
    best = best.filter(F.col("best.size") < 2 * gap).select(F.col("source").alias("of"), "best")
    rows = undrawn.join(best, undrawn["source"].eqNullSafe(best["of"]), "left").drop("of")
    same = F.coalesce(F.struct("size", "u", "tie") == F.col("best"), F.lit(False))
    rows = rows.withColumn("same", same)
    # Repeated rows are alike; one of them is taken.
    one = F.row_number().over(W.partitionBy("source").orderBy("size")) == 1
    picked = rows.filter("same").withColumn("drawn", one)
    return rows.filter("not same").withColumn("drawn", F.lit(False)).unionByName(picked).drop("same", "best")


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each document."""
    sized = written(docs.select(id_col, F.col(source_col).alias("source"), words(text_col).alias("size")), "sizes")
    plan = written(source_targets(sized, weights, share, most), "targets")
    fraction = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(fraction).cast("int")).withColumn(
        "room", F.col("target") - F.col("whole") * F.col("source_size")
    )
    plan = plan.withColumnRenamed("source", "of")
    drawable = (F.col("size") > 0) & (F.col("size") <= F.col("room"))
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["of"])).drop("of")
    can_give = rows.filter(drawable).groupBy(F.col("source").alias("of")).agg(F.sum("size").alias("words_left"))
    chance = written(can_give, "drawable")
    rows = rows.join(chance, rows["source"].eqNullSafe(chance["of"]), "left").drop("of")
    p = F.least(F.col("room") / F.col("words_left"), F.lit(1.0 - 1e-12))
    u = uniform(F.col(id_col), seed)
    rank = (u / (1 - u)) / (p / (1 - p))
    stratum = sum(((F.col("size") <= F.col("room") * top).cast("int") for top in STRATA), F.lit(0))
    rows = rows.withColumns(
        {"drawable": drawable, "u": u, "rank": F.when(drawable, rank), "tie": F.xxhash64(id_col), "stratum": stratum}
    ).withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS))
    rows = written(rows.withColumn("expected", p * F.col("size")), "ranked")
    every, missed = None, None
    for at in range(len(STRATA) + 1):
        part = rows.filter("drawable").filter(F.col("stratum") == at)
        room = part.select("source", F.col("expected").alias("words"))
        room = room if missed is None else room.unionByName(missed)
        drawn = written(lowest_ranks(part, room.groupBy("source").agg(F.sum("words").alias("words"))), f"stratum{at}")
        every = drawn if every is None else every.unionByName(drawn)
        miss = F.col("expected") - F.when(F.col("drawn"), F.col("size")).otherwise(0)
        left = drawn.select("source", miss.alias("words"))
        left = left if missed is None else left.unionByName(missed)
        missed = written(left.groupBy("source").agg(F.sum("words").alias("words")), "missed")
    every = every.unionByName(longest_last(rows.filter("not drawable"), every))
    return every.select(
        id_col, "source", "size", "source_size", "target", (F.col("whole") + F.col("drawn").cast("int")).alias("copies")
    )
