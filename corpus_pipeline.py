"""The corpus pipeline: toxicity, quality, near-duplicates, packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``.  ``run`` writes each stage as Parquet in the stage folder and reads it back as the
next stage's docs, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import near_copies, packing, quality_classifier, toxicity
from weftgraph.staging import stage_as_is as stage, table_as_is as table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on what is labelled here, does not reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on what is labelled here, does not reject."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of texts that SimHash links, as ``op8`` does, or whose
    five-word shingles are alike: the exact join finds what lies beyond the radius."""
    return near_copies.keep_alike(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("simhash", drop_near_duplicates),
    ("packing", pack),
]

#: Fitted models and tokenizers are not SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
