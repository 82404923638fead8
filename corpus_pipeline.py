"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data,
packing. Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and is written as Parquet and read again before the next. All stages but the
last return the columns of ``documents``, and any others that came with them.

Defined cases: null and empty texts are not toxic, hold no benchmark item and no
personal data; they have equal shingles, so one of them stays; a row without an id
passes all filters on its own; of rows that repeat an id those with equal shingles fall
together in the second stage, and others stay; an empty table stays empty; texts of any
length are worked on whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import packing, pii, similar, tiling, toxicity
from tideline.llm.common import materialise, prepare, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on those with labels, doesn't reject."""
    prepare(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, Jaccard
    similarity of 0.8 or more): that with the least id."""
    prepare(spark)
    return similar.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    prepare(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: A trained model, fingerprints and packing cannot be told in SQL; the stages are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
