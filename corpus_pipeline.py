"""The corpus pipeline: toxic documents go, then exact copies, near copies and benchmark passages; the rest is mixed.

Each stage works on all that its predecessor kept. All but the last return the
columns of documents; the last returns which documents to train on, how often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motionlake.llm import queries
from motionlake.llm.common import Tables, table
from motionlake.llm.decontaminate import drop_contaminated
from motionlake.llm.exact_dedup import drop_copies
from motionlake.llm.jaccard_join import drop_near_copies


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the grammar, learned from the labelled rows, scores as toxic."""
    return queries.not_toxic(docs, queries.toxicity_model(spark, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the one with the largest doc_id."""
    return drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of links: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a region that is a benchmark item up to its edit budget."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects the token prefixes that meet the target weights."""
    return queries.mixed(spark, docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

ORACLE_SQL = None  # the toxicity model and the edit distances are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark)
    for _, stage in STAGES[:-1]:
        before, docs = docs, tables.cut(stage(spark, docs, sf_dir))
        tables.free(before)  # what the next stage reads is written
    return STAGES[-1][1](spark, docs, sf_dir)
