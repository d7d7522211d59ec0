"""Corpus pipeline: quality rules, quality classifier, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the
stage before kept.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stationclim.llm import decontaminate, near_dup, packing, quality_model, quality_rules
from stationclim.llm.common import discard, materialise, table, tidied


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_inliers(docs)


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labelled documents of the whole table, whether or not they are still in ``docs``."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("quality_classifier", classified),
    ("near_dedup", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

# The outlier estimate, the trained classifier, the similarity search and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; a stage's documents are deleted when the next stage's are written.

    Null texts, languages, sources and ids, repeated rows and extra columns pass
    through as each stage defines them; an empty table gives no rows.
    """

    def apply() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            kept = tidied(lambda: materialise(stage(spark, docs, sf_dir), f"pipeline-{name}"))
            discard(docs)
            docs = kept
        return STAGES[-1][1](spark, docs, sf_dir)

    return tidied(apply)
