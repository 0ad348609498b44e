"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's documents. All but the last return the columns of ``documents``; rows with nulls, empty or
very long texts, ties, repeats and extra columns follow each operator's own definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality_rules
from factloom.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest doc_id stays."""
    return jaccard_join.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay at the rates that meet the target weights; none is repeated."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests, and the token ids."""
    return byte_bpe.encode_decode(docs, with_ids=True)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixed), ("byte-level BPE", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


#: SQL cannot express the near-duplicate, mixing and encoding stages; they are tested against brute force.
ORACLE_SQL = None
