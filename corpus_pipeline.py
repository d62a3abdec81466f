"""Training-data pipeline over ``documents``: quality rules, near-duplicates, personal data, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the columns of
``documents``; the last returns the pieces and their places. Columns beyond those of ``documents`` are left behind by the first stage that
meets them, whatever their names. An empty table goes through every stage as an empty table, and rows that repeat are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from joulemill.llm import mixing, neardup, packing, pii, quality
from joulemill.llm.registry import table
from joulemill.storage import cut

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject. A null, empty or short text has too few words and goes; a long one is read whole. Each row is
    judged for itself, so repeated rows stay or go together."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).filter("kept").select(DOCUMENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates. Only ids are shuffled to find the others, and they leave
    by an anti join; documents without an id are kept, and of rows that repeat an id all or none. Null and empty texts are like no other and stay; texts of
    any length are compared whole; between documents that are alike in everything the smaller id stays."""
    found = cut(neardup.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(found, "doc_id", "left_anti").select(DOCUMENT)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; ``n_chars`` follows the new text. Every row stays; a null text stays null, with null ``n_chars``; equal texts
    get equal pseudonyms, in long texts too."""
    return pii.pseudonymise(docs, pii.DEMO_KEY).withColumn("n_chars", F.length("text").cast("long")).select(DOCUMENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents until the sources have their target weights. A null source is a source of its own, the last one; null and
    empty texts weigh nothing and follow the rate of their source (none is taken from a source without words); rows that share an id, or have
    none, share a draw; long texts are taken whole or not."""
    return mixing.mix(docs).select(DOCUMENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row for each piece of a document. A null or empty text is its end token alone; a long one fills sequences of its
    own; rows that repeat an id are packed one by one."""
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", pseudonyms), ("mixing", mixture), ("packing", packed)]

#: The n-gram hash, the pseudonyms and the tokenizer are beyond SQL; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is written to the shared folder and read again, so a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
