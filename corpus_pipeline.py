"""Corpus pipeline: quality rules, quality classifier, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; what it returns is written as Parquet to the shared folder and reread.  The
filtering stages return the columns of ``documents``; the last returns a row per
piece with its place in a packed sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shipcast.llm import common, packing, quality_classifier, quality_rules, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def passing_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fixed rules and the fences of their language and source."""
    return quality_rules.keep_passing(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more.

    It learns from the labelled rows of the whole documents table: those that the
    rules removed are its best examples of bad text.
    """
    model = quality_classifier.fit(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model, 0.3)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group linked at two or fewer differing bits."""
    return simhash.keep_one_per_group(docs, shingle=3, radius=2)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their place in packed sequences."""
    return packing.packed_sequences(docs, common.tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", passing_rules),
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", without_near_duplicates),
    ("packing", packed),
]

# compression models and token packing are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each reads what the one before wrote."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
