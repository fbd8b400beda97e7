"""Training corpus from ``documents``: filter, deduplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it kept. ``run``
writes each stage's rows as Parquet in the shared folder and reads them back, so a lost
executor costs the current stage at most. All stages but the last return the columns they
were given.

Stages run one after the other in one session, whose Python workers and Arrow buffers are
kept from stage to stage; so each stage sends small Arrow batches.

An empty table passes through every stage. Rows with a null id are never taken for copies.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtrail.llm import mixing, near_dedup, packing, quality, secret_scan
from watchtrail.llm.shared import small_batches, table, written
from watchtrail.session import prepare

#: The probability of good quality from which a document stays.
GOOD = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels outside fold 0."""
    labels = table(prepare(spark), sf_dir, "labels")
    small_batches(spark)
    columns = docs.columns
    wrapped = docs.select("doc_id", "text", F.struct(*columns).alias("row"))
    scored = quality.score(wrapped, labels, quality.fold("doc_id", 5) != 0)
    return scored.filter(F.col("score") >= GOOD).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    small_batches(spark)
    found = written(near_dedup.near_duplicates(docs).select("doc_id", "kept"), "copies")
    copies = found.filter("not kept").select("doc_id").distinct()
    left = docs.join(copies.hint("shuffle_hash"), "doc_id", "left_anti")
    repeated = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = written(repeated, "repeated")
    if not repeated.isEmpty():
        once = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        left = left.join(repeated, "doc_id", "left_anti").unionByName(once)
    return left.select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by a mark."""
    wrapped = docs.select("text", F.struct(*docs.columns).alias("row"))
    clean = secret_scan.redact(secret_scan.scan(wrapped, whole=True))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.size("secret_spans") > 0, length).otherwise(F.col("row.n_chars"))
    return clean.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; rows of one id are taken alike."""
    mixed = mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)
    copies = mixed.groupBy(F.col("doc_id").alias("of")).agg(F.max("copies").alias("copies")).filter("copies > 0")
    wrapped = docs.select("doc_id", F.struct(*docs.columns).alias("row"))
    taken = wrapped.join(copies.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_dedup", drop_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL cannot express the classifier or the tokenizer; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
