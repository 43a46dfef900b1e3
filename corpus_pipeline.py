"""Training-data pipeline over ``documents``: toxicity, quality rules, near duplicates, repeated
substrings, packing. Every stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadstone.llm import jaccard, packing, quality, suffix_array, tokens, toxicity
from loadstone.llm.common import stored, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; learnt from the labelled documents among ``docs``."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the standard policy accepts."""
    return quality.keep_good(docs)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one of least id."""
    return jaccard.keep_one(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 200 bytes that also start elsewhere; n_chars follows the text."""
    return suffix_array.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences, with their token ids."""
    return packing.pack(docs, tokens.default_tokenizer())


STAGES = [
    ("toxicity", toxic_out),
    ("quality_rules", poor_out),
    ("ngram_jaccard_join", copies_out),
    ("suffix_array_dedup", repeats_out),
    ("packing", packed),
]
ORACLE_SQL = None  # learnt weights, byte strings and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
