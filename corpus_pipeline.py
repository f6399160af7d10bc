"""The corpus pipeline: language, quality, near-duplicates, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of their input. `run` applies them to `documents`, each stage's result written to
the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm import language_id, near_duplicates, packing, private_data, quality_rules
from loomgrid.llm.common import discard, materialise, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; those without letters or between languages go."""
    return language_id.filter_language(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8."""
    return near_duplicates.keep_first(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and what discloses it replaced."""
    return private_data.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", pack)]

#: Trained classifiers, sketches and tokenizers are beyond SQL; tests hold each stage against a plain version of its decision.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
