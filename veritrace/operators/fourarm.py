"""Four paired arms per item: gains, difference-in-differences, subsets and summaries.

a: closed book, original key; b: open book, original; c: closed book, edited key; d: open
book, edited. Apparent gain is b - a, corrected gain d - c, DiD their difference
(apparent - corrected), masking the reverse. Means over no rows are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import numeric as N

ARMS = ("a", "b", "c", "d")


def apparent() -> Column:
    return F.col("b") - F.col("a")


def corrected() -> Column:
    return F.col("d") - F.col("c")


def did() -> Column:
    return apparent() - corrected()


def masking() -> Column:
    return corrected() - apparent()


def with_gains(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"apparent": apparent(), "corrected": corrected(), "did": did(), "masking": masking()})


def valid(rows: DataFrame) -> DataFrame:
    """Rows whose four arms are 0 or 1."""
    ok = F.lit(True)
    for arm in ARMS:
        ok = ok & F.coalesce(F.col(arm).isin(0, 1), F.lit(False))
    return rows.where(ok)


def issues(rows: DataFrame, config_key: str | None = None) -> DataFrame:
    """A row for each broken constraint: which item, which rule."""
    checks = [F.when(~F.coalesce(F.col(arm).isin(0, 1), F.lit(False)), F.lit(f"arm {arm}")) for arm in ARMS]
    if config_key is not None:
        checks.append(F.when(~F.col("config_key").eqNullSafe(F.lit(config_key)), F.lit("config key")))
    return rows.select("question_id", "model", F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def eligible(policy: str, pair_hit: Column) -> Column:
    """Items of the per-protocol subset: with a strict policy those whose gold passage both arms retrieved, else all that are sound."""
    if policy == "require_pair_hit":
        return F.coalesce(pair_hit, F.lit(False))
    if policy == "structural_only":
        return F.lit(True)
    raise ValueError(f"unknown policy: {policy}")


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Intention-to-treat and per-protocol means for each group, from one pass with partial sums."""
    kept = F.coalesce(F.col("passed_gates"), F.lit(True))
    mean = lambda c, when=None: F.round(F.avg(c if when is None else F.when(when, c)), 9)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[mean(F.col(arm)).alias(f"mean_{arm}") for arm in ARMS],
        mean(apparent()).alias("apparent_gain"),
        mean(corrected()).alias("corrected_gain"),
        mean(did()).alias("did"),
        mean(masking()).alias("masking"),
        F.count_if(kept).alias("n_pp"),
        mean(did(), kept).alias("did_pp"),
        mean(masking(), kept).alias("masking_pp"),
    )


def power_table(rows: DataFrame, *keys: str, deltas=SETTINGS.effect_deltas) -> DataFrame:
    """Variance of DiD and the items needed to see each effect."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.var_samp(did()), F.lit(0.0)).alias("v"))
    return out.select(*keys, "n", F.round("v", 9).alias("did_variance"), *[N.n_required(F.col("v"), x).alias(f"n_{round(x * 100)}pp") for x in deltas])


def grouping_summary(rows: DataFrame, key: str) -> DataFrame:
    """Overall and by stratum in one aggregate."""
    return (
        rows.groupingSets([[], [F.col(key)]], F.col(key))
        .agg(F.count("*").alias("n"), F.round(F.avg(masking()), 9).alias("masking"), F.grouping(key).alias("overall"))
        .select(F.when(F.col("overall") == 1, F.lit("ALL")).otherwise(F.col(key)).alias("stratum"), "n", "masking")
    )


def leave_one_out(cells: DataFrame, key: str, value: Column) -> DataFrame:
    """Mean of value without each key in turn, from totals less the key's own: no cross join."""
    own = cells.groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = own.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return own.join(F.broadcast(total)).select(F.col(key).alias("dropped"), (F.col("tn") - F.col("n")).alias("n"), F.round(F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")), 9).alias("mean_without"))


def nested_subsets(rows: DataFrame) -> DataFrame:
    """Items by subset: all, structural, term present, compliant; each within the one before, over all depths of an item."""
    flags = rows.groupBy("question_id", "model").agg(
        F.bool_and(F.coalesce("passed_gates", F.lit(True))).alias("structural"),
        F.bool_and(F.col("b") + F.col("d") > 0).alias("term"),
        F.bool_and(F.col("d") == 1).alias("compliant"),
    )
    names = F.array(
        F.lit("all"),
        F.when(F.col("structural"), F.lit("structural")),
        F.when(F.col("structural") & F.col("term"), F.lit("term_present")),
        F.when(F.col("structural") & F.col("term") & F.col("compliant"), F.lit("compliant")),
    )
    return flags.select("question_id", "model", F.explode(F.array_compact(names)).alias("subset"))


def k_report(rows: DataFrame) -> DataFrame:
    """Means by model, depth and nested subset."""
    return summary(rows.join(nested_subsets(rows), ["question_id", "model"]), "model", "k", "subset")


def transitions(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Items by how b and d move between two depths: one pass with a pivot by conditional maximum."""
    at = lambda arm, k: F.max(F.when(F.col("k") == k, F.col(arm)))
    pair = rows.where(F.col("k").isin(low, high)).groupBy("question_id", "model").agg(*[at(x, k).alias(f"{x}{k}") for x in "bd" for k in (low, high)])
    state = lambda x: F.concat(F.col(f"{x}{low}").cast("string"), F.lit(">"), F.col(f"{x}{high}").cast("string"))
    return pair.groupBy("model", state("b").alias("b_state"), state("d").alias("d_state")).agg(F.count("*").alias("n"))


def monotone(cells: DataFrame) -> DataFrame:
    """Shape of corrected gain over depth for each model, and the depth where it is least."""
    from pyspark.sql import Window as W

    w = W.partitionBy("model").orderBy("k")
    step = cells.withColumn("step", F.col("gain") - F.lag("gain").over(w))
    shape = F.when(F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True)), "non-decreasing").when(F.bool_and(F.col("step") <= 0), "non-increasing").otherwise("mixed")
    return step.groupBy("model").agg(shape.alias("shape"), F.min_by("k", F.struct("gain", "k")).alias("trough_k"), F.count("*").alias("n_depths"))


def rank_change(cells: DataFrame) -> DataFrame:
    """Rank of each configuration by apparent and by corrected gain; ties by name. cells: config, apparent, corrected."""
    from pyspark.sql import Window as W

    rank = lambda c: F.row_number().over(W.orderBy(F.desc(c), "config"))
    return cells.select("config", rank("apparent").alias("apparent_rank"), rank("corrected").alias("corrected_rank")).withColumn("moved", F.col("apparent_rank") - F.col("corrected_rank"))


def strength_bins(rows: DataFrame) -> DataFrame:
    """Cost (b - d) by how many of the other models answer the item closed-book."""
    from pyspark.sql import Window as W

    others = (F.sum("a").over(W.partitionBy("question_id")) - F.col("a")).cast("int")
    return rows.withColumn("strength", others).groupBy("model", "strength").agg(F.count("*").alias("n"), F.round(F.avg(F.col("b") - F.col("d")), 9).alias("cost"))
