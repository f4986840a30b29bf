"""Registered queries of the package, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import (
    collocations,
    decontamination,
    extraction,
    mtree,
    packing,
    projections,
    quality,
    ranking,
    revisits,
    simhash,
    substrings,
    suffixes,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(
        _table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@_query
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.substring_dedup(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query
def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_dedup(spark, _table(spark, folder, "documents"))
    return groups.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


@_query
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op10_benchmark_decontamination"] = decontamination.ORACLE


@_query
def op2_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffixes.suffix_array_dedup(spark, _table(spark, folder, "documents"))
    return kept.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def quality_model(spark: SparkSession, docs: DataFrame, folder: str) -> quality.Model:
    labels = _table(spark, folder, "labels").where(~quality.held_out(F.col("doc_id"), 4, 2))
    return quality.train(docs, labels)


@_query
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.with_score(docs, quality_model(spark, docs, folder))
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@_query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels").where(~quality.held_out(F.col("doc_id"), 3, 1))
    scored = toxicity.with_score(docs, toxicity.train(spark, docs, labels))
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@_query
def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & ~broken).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector")
    )
    return mtree.top_inner_products(spark, rows, rows.where("vec_id % 50 = 0"))


ORACLES["op9_exact_topk"] = mtree.ORACLE


@_query
def op1_revisit_resolution(spark: SparkSession, folder: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.records_of_pages(_table(spark, folder, "pages")))
    fields = F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit(": "), x["value"]))
    return found.select(
        "record_id", "refers_to", "outcome", F.array_join(fields, "\n").alias("headers"), F.col("payload_digest").alias("payload_sha256")
    )


ORACLES["op1_revisit_resolution"] = revisits.ORACLE


@_query
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    texts = extraction.extract(_table(spark, folder, "pages").select("page_id", "url", "html"), extraction.train())
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op11_projection_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return projections.near_vectors(spark, _table(spark, folder, "embeddings"))


ORACLES["op11_projection_near_dedup"] = projections.ORACLE


@_query
def op12_max_sketch_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.ranked_search(spark, _table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


ORACLES["op12_max_sketch_search"] = ranking.ORACLE


@_query
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(spark, _table(spark, folder, "documents"))


ORACLES["op13_phrase_collocations"] = collocations.ORACLE
