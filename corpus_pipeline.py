"""Corpus pipeline: quality classifier, language ID, exact duplicates, near duplicates, packing.

Each stage takes all rows that the one before kept, written as Parquet and read again; every stage but the last returns
the columns of documents. A stage has no verdict to give, and so keeps all rows, where it has nothing to learn from.

Each row has its own verdict: rows that repeat a doc_id are told apart by their texts, and of rows equal in both one is left
by the third stage. Null and empty texts go in the first stage (in the second, where the first has no labels). Rows without
doc_id are copies of nothing and stay. Empty tables give an empty result; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonewalk.llm import exact_dedup, language, packing, quality, shingles
from zonewalk.llm.common import materialise, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is identified."""
    return language.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents, the one that stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a similarity of 0.8 or more in five-word shingles, directly or through others, the one with the smallest doc_id.

    Candidates are the SimHash links of operator 1 on those shingles, and those that share a MinHash band beyond its two bits.
    """
    return shingles.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and place of every document left."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("packing", packed),
]

#: The learned stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
