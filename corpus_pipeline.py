"""Five operators in a row over documents; each stage's output is written as Parquet and read again by the next.

For all stages: an empty table gives an empty one; columns beside doc_id and text, null or with
any name, are carried along untouched by the first four and are in no one's way; very long
texts are read whole; rows that repeat are judged alike, each on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritrace.llm import decontaminate, jaccard, mixing, quality_model, quality_rules
from veritrace.llm.common import table, written


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what any rule rejects. A null or empty text has too few words and goes; doc_id is not looked at."""
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what scores under 0.3. The model learns from all labelled documents: most of the bad ones are no longer in docs.

    A null or empty text gets the bias alone. A document with two labels counts with the lesser; without labels the
    score is 0.5 and all stay. A score of just 0.3 stays.
    """
    model = quality_model.fit(table(spark, sf_dir, "documents"), quality_model.learning_labels(table(spark, sf_dir, "labels")))
    return quality_model.keep_good(docs, model)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group.

    Rows of that doc_id all stay, as doc_id is what a document is told by. Null and empty texts are groups of their own,
    rows with a null doc_id stay.
    """
    return jaccard.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Null texts hold none; items without an id or words are in none."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A rate for each document left. Texts without tokens get the overall rate; without labels there is one domain."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The trained stages are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
