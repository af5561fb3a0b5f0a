"""A pipeline over the documents: toxicity, near-duplicates, benchmark contamination, personal data, tokens.

Every stage takes the documents that the one before kept and returns a table; all but the last return the columns of
``documents``. Between stages the documents are a Parquet table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm.bpe import bpe_encode_checked
from webloom.llm.common import stored
from webloom.llm.decontam import drop_contaminated
from webloom.llm.pii import redact_pii
from webloom.llm.registry import BYTE_VOCABULARY, table
from webloom.llm.simhash import drop_near_duplicates
from webloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar learned from the labels takes for toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), short_inside=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return redact_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of the text that they decode to."""
    return bpe_encode_checked(docs, BYTE_VOCABULARY, keep=[c for c in docs.columns if c != "text"])


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: What the learned stages decide cannot be said in SQL; tests compare the rows with brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
