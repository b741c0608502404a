"""The corpus pipeline: five stages, each of which reads what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Part of candlewick.llm, whose operators it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import line_dedup, mixing, quality, simhash
from candlewick.llm.common import table, written
from candlewick.llm.queries import encoded_digests

#: Nine words in ten stay, each document once, shared out by the tree's weights.
MIX = mixing.Mix(share=0.9, max_epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified cutoffs turn away go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is similar to go out of their texts."""
    return line_dedup.deduplicated_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest doc_id stays."""
    return simhash.one_of_each_group(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond their source's share go."""
    return mixing.mixed_documents(docs, MIX)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For every document its number of ids, and digests of them and of what they decode to."""
    return encoded_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_deduplication", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither the certified cutoffs nor the components and merges; the tests
#: hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
