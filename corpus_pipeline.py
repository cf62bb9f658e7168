"""The corpus pipeline: five stages, each by one operator of fenestra.llm.

Every stage works on all that the one before it kept. Extra columns of the
documents are passed through; columns that a stage needs are doc_id, text and,
for mixing, source. Null and empty texts pass all stages and encode to nothing,
unless mixing, to which they offer no words, takes none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fenestra.llm import bpe, mixing, pii, simhash, toxicity
from fenestra.llm.common import cut, table


def toxicity_filtered(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that with the smallest doc_id."""
    return simhash.deduplicated(docs)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and words that disclose it, are replaced in the texts."""
    return pii.sanitised(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document, in training order."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of token ids, and of the bytes that they decode to."""
    return bpe.apply(docs)


STAGES = [
    ("toxicity", toxicity_filtered),
    ("simhash", near_deduplicated),
    ("pii", sanitised),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: Tokens, string-kernel scores and fingerprint links can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what each gives is written once, for the next reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
