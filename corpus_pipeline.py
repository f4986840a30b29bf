"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the one before kept.
All but the last return the columns of documents. Stages are written as Parquet in the shared
folder and read again, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import decontamination, packing, quality, similar, suffixes
from pulseframe.llm.components import passing_tables, remove_table
from pulseframe.llm.queries import quality_model
from pulseframe.session import scratch_path

#: Repeated strings of so many bytes go: passages of 50 words, even of short ones. The anchor is half of it.
REPEATED_BYTES = 200

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes as good; null and empty texts are judged like any
    other, rows that repeat alike, and extra columns stay, whatever their names."""
    model = quality_model(spark, docs, sf_dir)
    # The documents' own columns travel in one, so that no name can clash.
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return quality.with_score(rows, model).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8. The smallest
    id stays, nulls last; of rows alike in id and text, any one."""
    return similar.one_of_each(spark, docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of ``REPEATED_BYTES`` bytes that occur elsewhere too; ``n_chars``
    is counted anew. A document of which nothing is left stays, with an empty text, as do null and
    empty texts. Rows that repeat each count as a document. Extra columns stay, whatever their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(F.struct(*others).alias("row"), "text")
    kept = suffixes.suffix_array_dedup(spark, rows, "row", "text", REPEATED_BYTES, REPEATED_BYTES // 2, as_text=True)
    new = kept.select("row.*", F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts stay, and rows
    that repeat stay or go together."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("near duplicates", distinct_documents),
    ("repeated strings", without_repeats),
    ("benchmark decontamination", uncontaminated_documents),
    ("packing", packed_sequences),
]

#: The classifier is trained, the groups of near duplicates are found round by round and the
#: tokens come from a vocabulary: no SQL text expresses them. Tests compare each stage with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with ExitStack() as before:
        for number, (_, stage) in enumerate(STAGES):
            with passing_tables(spark):
                path = scratch_path(spark, f"stage{number}")
                stage(spark, docs, sf_dir).write.parquet(path)
            # What the stage read is needed no more, once its result is whole.
            before.close()
            if number < len(STAGES) - 1:
                before.callback(remove_table, spark, path)
            docs = spark.read.parquet(path)
    return docs
