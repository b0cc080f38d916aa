"""The corpus pipeline: five stages over `documents`, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each result to the shared folder and reads it again, so a
stage starts from a table and survives the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, mixing, quality, queries, simhash, suffix_dedup
from tidemill.llm.common import written

#: The mix of the pipeline: four fifths of the tokens that are left, no source twice.
PIPELINE_MIX = mixing.Mix(weights=queries.MIX.weights, budget_num=4, budget_den=5, max_epochs=1, seed="pipeline")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the rule ledger rejects go."""
    return quality.keep(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, max_bits=6, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """200-byte strings that occur twice or more are cut from the texts."""
    return suffix_dedup.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the source mix takes."""
    leaf = mixing.leaf_columns(docs, queries.domain_of(F.col("source")))
    counts = written(docs.select(*leaf, mixing.tokens(F.col("text")).alias("n_tokens")), "token-counts")
    leaves = mixing.plan(counts, PIPELINE_MIX)
    return mixing.select(docs, leaves, PIPELINE_MIX, leaf[1:], with_epoch=False)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's token count, and digests of its ids and of what they decode to."""
    return bpe.digests(bpe.encode_decode(docs, queries.tokenizer_file(), queries.tokenizer_pattern()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
