"""The corpus operators as queries over the given tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtrail.llm import (
    fill_middle,
    interpolation,
    language,
    mixing,
    near_dedup,
    packing,
    phrases,
    quality,
    secret_scan,
    substring_dedup,
    token_count,
    top_scores,
    vector_dedup,
)
from watchtrail.llm.shared import table
from watchtrail.session import prepare


VOCABULARY = "word_bpe_49k.json"


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    fold = quality.fold("doc_id", 5)
    scored = quality.score(docs, table(spark, sf_dir, "labels"), fold != 0)
    return scored.select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, public_tokenizers.path(VOCABULARY), sequence=2048, end=1)
    return packed.withColumn("length", F.col("length").cast("long"))


def op4_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    # Remainder 0 is never learnt from, remainder 1 teaches the weights.
    use = F.least(quality.fold("doc_id", 10), F.lit(interpolation.KEPT))
    found = interpolation.model_scores(docs.select("doc_id", "text", use.alias("use")))
    held_out = (F.col("use") == interpolation.EVALUATED).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    mixed = mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)
    taken = (F.col("copies") * F.col("size")).cast("long")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op6_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(prepare(spark), sf_dir, "embeddings")
    return top_scores.top_scores(vectors, F.col("vec_id") % 50 == 0, k=5)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    held_out = quality.fold("doc_id", 4) == 2
    model = language.learn(docs.filter(~held_out).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return token_count.count_tokens(docs, public_tokenizers.path(VOCABULARY))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, secret_scan.KINDS[:3])
    return found.select("doc_id", *counts, F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("secret_spans").alias("spans"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(prepare(spark), sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return phrases.collocations(docs, least=30, longest=4, share=80, top=2000)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    found = fill_middle.fill_middle(docs, plain=10, spm=20)
    restored = fill_middle.restore(F.col("fim_text"), F.col("fim_form"))
    return found.select(
        "doc_id",
        F.col("fim_n").alias("n"),
        F.col("fim_form").alias("form"),
        "prefix_chars",
        "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_dedup,
        op2_quality,
        op3_pack,
        op4_model_scores,
        op5_mix_sources,
        op6_top_scores,
        op7_language,
        op8_token_counts,
        op9_secret_scan,
        op10_vector_dedup,
        op11_collocations,
        op12_fill_middle,
        op13_substring_dedup,
    )
}
