"""A training corpus from raw documents: the stages in order, each over all that its predecessor kept.

The result is the corpus itself: all columns of the documents that are left, personal data replaced, and each one's rate.

Every stage takes rows as they are: ids may be null or repeated, texts null, empty or very long, tables empty, and further
columns (whatever their names) pass through. Null and empty texts have the score of an empty text, form one group of
near-duplicates, hold no item and no personal data, and have no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarmac.llm.common import stash, table
from tarmac.llm.decontam import keep_clean
from tarmac.llm.mixing import domains_of, with_rates
from tarmac.llm.pii import redact
from tarmac.llm.quality import keep_good
from tarmac.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; repeated rows have the same score and go or stay together."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest id's, ties by a hash of the row. Repeated rows leave one."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; an empty benchmark removes nothing."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null, repeated rows stay repeated."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their rate for the target weights of the domains; rows without tokens keep a rate, which moves nothing."""
    return with_rates(docs, domains_of(table(spark, sf_dir, "labels")))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("mixing", mixing)]

#: The stages hash shingles, compress and train: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again as the next one's input.

    Returns the columns of documents and rate, a row for each document that is left; none from an empty table.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
