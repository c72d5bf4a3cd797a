"""A training-data pipeline over documents, as part of tallyweave.llm.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has left, and returns a DataFrame; all but
the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm.exact_dedup import deduplicate
from tallyweave.llm.ngram_join import keep_one_of_each
from tallyweave.llm.packing import pack_documents
from tallyweave.llm.secret_scan import redact
from tallyweave.llm.shared import dropped, saved, stage_tables
from tallyweave.llm.toxicity import reject_toxic


def _stage(work):
    """A stage that first deletes what the stage before it kept on the way to its written result."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_tables(docs):
            return work(spark, docs, sf_dir)

    return run


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic (0.7 or more) go."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return deduplicate(docs)


@_stage
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, directly or by way of others, the
    smallest doc_id stays."""
    return keep_one_of_each(docs)


@_stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return redact(docs)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 4096 tokens at most."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Scores learned from labels can't be had in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
