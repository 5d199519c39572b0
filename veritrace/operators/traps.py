"""Audits of edits that change nothing, and of single windows of a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def noop_audit(substituted: DataFrame, *keys: str) -> DataFrame:
    """Edits whose new key is an alias of the old answer, their rate, and how many spellings the items' answers have.

    substituted: keys, new_key and aliases; empty aliases do not count."""
    known = F.filter(F.transform("aliases", T.normalize_answer), lambda a: a != "")
    new = T.normalize_answer("new_key")
    rows = substituted.select(*keys, F.size(known).alias("forms"), ((new != "") & F.array_contains(known, new)).cast("int").alias("noop"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("noop").alias("noop"), F.round(F.avg("noop"), 9).alias("rate"), F.percentile("forms", F.lit(0.5)).cast("double").alias("median_forms"), F.round(F.avg("forms"), 2).alias("mean_forms")
    )


def window_conditions(items: DataFrame) -> DataFrame:
    """Contexts that tell a single bad window from dilution: the gold passage alone, the deep top, the gold passage with
    each window that depth adds, and the shallow top where it lacks the gold passage.

    items: question_id, gold_id, shallow and deep (arrays of ids in rank order); a row for each condition."""
    added = F.array_except("deep", "shallow")
    one = lambda tag, ids: F.struct(F.lit(tag).alias("tag"), ids.alias("ids"))
    each = F.transform(added, lambda x, i: F.struct(F.concat(F.lit("c2_w"), (i + 1).cast("string")).alias("tag"), F.array(F.col("gold_id"), x).alias("ids")))
    actual = F.when((F.size("shallow") > 0) & ~F.array_contains("shallow", F.col("gold_id")), F.array(one("c3_k1_actual", F.col("shallow"))))
    conditions = F.concat(F.array(one("c0_gold", F.array("gold_id")), one("c1_k5", F.col("deep"))), each, F.coalesce(actual, F.slice(each, 1, 0)))
    return items.select("question_id", F.explode(conditions).alias("x")).select("question_id", "x.*")


def window_attribution(conditions: DataFrame, em: Column) -> DataFrame:
    """By condition: items, those answered with the new key, and their rate."""
    return conditions.groupBy("tag").agg(F.count("*").alias("n"), F.sum(em.cast("int")).alias("answered_new"), F.round(F.avg(em.cast("int")), 9).alias("rate"))
