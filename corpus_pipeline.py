"""Cleaning pipeline over `documents`: each stage's rows are written and are the next one's input.

Rows with null text fail the quality rules and go there; ids, nulls, ties and repeated rows
are treated as each operator says, and an empty table gives an empty one. Columns beyond
those of `documents` go along, whatever they are called; the mix adds `copy`. Documents that
no stage rejects reach the mix unchanged but for personal data, which gives way to the name
of its kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, minhash_dedup, mixing, pii, quality_rules
from quillspark.llm.common import scratch, small_batches, staged, table

#: Similarity, in per cent, of near-duplicates of which one stays.
ALIKE = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive fences keep."""
    small_batches(spark)
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    small_batches(spark)
    return minhash_dedup.representatives(docs, ALIKE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    small_batches(spark)
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the number `copy` from 0."""
    small_batches(spark)
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", personal_data),
    ("mix", mix),
]
#: SQL has no form of the signatures, the latent search or the checksums.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # the tables on the way to a stage's result
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
