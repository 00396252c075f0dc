"""From raw documents to packed training sequences: five stages, each one operator over all rows of the stage before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import exact, mixing, near, packing, quality
from caseflow.llm.common import durable, settle, table
from caseflow.llm.queries import public_vocabulary

#: The stage takes copies from a similarity of 0.8 on (op5_near_dedup: 0.85); 36 x 5 hashes miss a pair at 0.8 with a chance of 6e-7.
SIMILAR = near.Near(percent=80, bands=36, rows=5)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labelled ones among them, rejects go."""
    return quality.without_rejected(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    settle(spark)
    return exact.without_copies(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest doc_id stays."""
    settle(spark)
    return near.without_near_copies(docs, SIMILAR)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are there as often as the mix uses them."""
    settle(spark)
    return mixing.mixture(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    settle(spark)
    return packing.packed(docs, packing.Packing(public_vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("near dedup", dissimilar_documents),
    ("mixing", mixed_documents),
    ("packing", packed_documents),
]

#: A trained classifier and a tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
