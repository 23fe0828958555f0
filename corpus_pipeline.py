"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm._scale import keep, working_tables
from quakeloom.llm.decontaminate import drop_contaminated
from quakeloom.llm.exact_dedup import drop_exact_copies
from quakeloom.llm.language_id import held_out, keep_languages, rate_limit, train
from quakeloom.llm.ngram_join import drop_near_copies
from quakeloom.llm.packing import pack


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that labelled documents are in; texts of no language, or of another, go."""
    out = held_out(F.col("doc_id"))
    model = train(docs.filter(~out))
    return keep_languages(docs, model, limit=rate_limit(docs.filter(out), model))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts differ in white space only."""
    return drop_exact_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return drop_near_copies(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, placed in sequences of at most 2048 tokens."""
    return pack(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_similar),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: Byte context trees and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is a Parquet table in the shared folder, read by the next.

    A stage's own working tables are deleted once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with working_tables(spark):
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
