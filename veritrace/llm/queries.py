"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, html_extract, jaccard, langid, licenses, lines, masked_lm, merkle, mixing, quality_model, quality_rules, token_prefix
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.digest(langid.predicted(docs, langid.fit(langid.learnable(docs))))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, quality_model.learning_labels(table(spark, sf_dir, "labels")))
    return quality_model.digest(quality_model.scored(docs, model))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(html_extract.extract(table(spark, sf_dir, "pages")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefix.digest(token_prefix.token_counts(table(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measured(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = masked_lm.encoded(docs, masked_lm.vocabulary(docs))
    return masked_lm.digest(masked_lm.scored_words(words, masked_lm.learned(words)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_ngram_jaccard_join, op4_quality_classifier, op5_html_extraction, op6_token_counts, op7_mixing, op8_quality_rules, op9_lm_scoring, op10_license_scan, op11_line_dedup, op12_merkle_manifest, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.ORACLE_SQL, "op3_ngram_jaccard_join": jaccard.ORACLE_SQL, "op8_quality_rules": quality_rules.ORACLE_SQL, "op11_line_dedup": lines.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL, "op13_conversation_repair": conversations.ORACLE_SQL}
