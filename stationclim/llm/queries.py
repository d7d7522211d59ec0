"""Registered queries of the training-data operators: ``opN_<name>`` over the whole tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat, decontaminate, filter_audit, language_id, language_model, licences, near_dup, packing, quality_model, quality_rules, sharding, token_counts, whitening)
from .common import table, tidied


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op4_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.hits(docs, bench))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_scores(table(spark, sf_dir, "documents"))


def op6_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_texts(spark))


def op7_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.robust_outliers(table(spark, sf_dir, "documents"))


def op9_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.windows(chat.with_planted(table(spark, sf_dir, "conversations"))))


def op10_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op12_posting_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _tidy(query):
    """The query, leaving no scratch folder but those that its result reads."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidied(lambda: query(spark, sf_dir))

    return run


QUERIES = {f.__name__: _tidy(f) for f in (
    op1_bag_minhash, op2_attention_mil, op3_label_propagation, op4_prefix_join, op5_attention_lm, op6_licence_digests, op7_viterbi_counts, op8_robust_outliers,
    op9_budgeted_windows, op10_conflict_best_fit,
    op11_subword_language, op12_posting_audit, op13_feast_whitening)}


def oracles() -> dict[str, str]:
    return {"op4_prefix_join": decontaminate.ORACLE, "op6_licence_digests": licences.oracle(), "op9_budgeted_windows": chat.ORACLE,
            "op12_posting_audit": filter_audit.oracle()}
