"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

All stages take nulls in any column (a null text counts as empty), texts of any length, repeated rows, shared and missing
doc_ids, empty tables and further columns of any name, which all but the last stage pass on. What each makes of them:
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framegraph.llm.common import materialize, table
from framegraph.llm.decontamination import drop_contaminated
from framegraph.llm.exact_dedup import drop_exact_copies
from framegraph.llm.near_dedup import drop_near_copies
from framegraph.llm.packing import TOKENIZER, pack
from framegraph.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, learned from labels, does not call toxic.

    Null and empty texts are judged by the thresholds alone, repeated rows alike. Without labels of both kinds all stay.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, the one with the largest doc_id.

    Null ids rank below all others; of repeated rows with that id one stays; null and empty texts are one group.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id.

    Null ids rank below all others; of rows equal in doc_id and text one stays; texts without words are no copies.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Rows are judged by their own text; texts without words, and all where the benchmark is empty, stay.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    Null and empty texts make a piece of one id; longer documents than a sequence are cut; repeated rows are packed each.
    """
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A learned stage has no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
