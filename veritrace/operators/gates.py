"""Validity gates: item predicates, and aggregate gates with a three-state outcome.

An aggregate gate with fewer than `least_n` items is INSUFFICIENT and its `passed` is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import numeric as N
from ..functions import text as T


def _outcome(df: DataFrame, keys: list[str], gate: int, n: Column, value: Column, passed: Column, verdict: Column) -> DataFrame:
    enough = n >= SETTINGS.gates[gate].least_n
    return df.select(
        *keys,
        F.lit(gate).alias("gate_id"),
        n.cast("long").alias("n"),
        F.round(value, 9).alias("value"),
        F.when(enough, passed).alias("passed"),
        F.when(enough, F.lit("JUDGED")).otherwise("INSUFFICIENT").alias("status"),
        verdict.alias("verdict"),
    )


def gate1(hits: DataFrame, *keys: str) -> DataFrame:
    """Retrieval equivalence. hits: orig_hit and sub_hit of each item."""
    lim = SETTINGS.gates[1]
    g = hits.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg((F.col("orig_hit") & F.col("sub_hit")).cast("int")).alias("retain"),
        (F.avg(F.col("orig_hit").cast("int")) - F.avg(F.col("sub_hit").cast("int"))).alias("drop"),
    )
    enough = F.col("n") >= lim.least_n
    base = N.verdict(F.col("drop"), lim.go, lim.abandon, lim.direction, enough)
    judged = F.when(enough & (F.col("retain") < SETTINGS.retain_min), F.when(F.col("retain") < 0.5, "ABANDON").otherwise("REVISE")).otherwise(base)
    return _outcome(g, list(keys), 1, F.col("n"), F.col("retain"), (F.col("retain") >= SETTINGS.retain_min) & (F.col("drop") <= lim.passes), judged)


def transition_matrix(rows: DataFrame, *keys: str) -> DataFrame:
    """Among items right closed-book (`correct`): classes (`cls`) after the edit, their shares and the interval of the residual."""
    right = F.col("correct")
    g = rows.groupBy(*keys).agg(F.count_if(right).alias("denom"), *[F.count_if(right & (F.col("cls") == c)).alias(f"n_{c}") for c in ("old", "new")])
    g = g.withColumn("n_other", F.col("denom") - F.col("n_old") - F.col("n_new"))
    lo, hi = N.wilson(F.col("n_old"), F.col("denom"))
    share = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("denom").cast("double")), 9)
    return g.select(*keys, "denom", "n_old", "n_new", "n_other", share("n_old").alias("residual_old"), F.round(lo, 9).alias("ci_low"), F.round(hi, 9).alias("ci_high"), share("n_new").alias("p_new"), share("n_other").alias("p_other"))


def gate2(rows: DataFrame, *keys: str, multi: bool = False, large: Column | None = None) -> DataFrame:
    """Closed-book collapse: the old answer must not survive the edit."""
    m = transition_matrix(rows, *keys)
    one, several, big = SETTINGS.residual
    limit = F.lit(several if multi else one)
    limit = limit if large is None else F.when(large, F.lit(big)).otherwise(limit)
    lim, resid, n = SETTINGS.gates[2], F.col("residual_old"), F.col("denom")
    judged = N.verdict(resid, limit, lim.abandon, lim.direction, n >= lim.least_n)
    out = _outcome(m.withColumn("seq", N.sequential(resid, n)), list(keys) + ["seq"], 2, n, resid, (resid <= limit) & (F.col("ci_high") <= limit + 0.05), judged)
    return out.withColumn("seq", F.when(F.col("status") == "JUDGED", F.col("seq")))


def gate3(rows: DataFrame, *keys: str) -> DataFrame:
    """Answerability with gold evidence: em_orig and em_sub of each item."""
    lim = SETTINGS.gates[3]
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.avg("em_orig") - F.avg("em_sub")).alias("drop"))
    size = F.abs(F.col("drop"))
    return _outcome(g, list(keys), 3, F.col("n"), F.col("drop"), size <= lim.passes, N.verdict(size, lim.go, lim.abandon, lim.direction, F.col("n") >= lim.least_n))


def gate4(rows: DataFrame, *keys: str, large: Column | None = None) -> DataFrame:
    """Compliance with conflicting evidence: share of class `new`."""
    lim = SETTINGS.gates[4]
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("cls") == "new").cast("int")).alias("rate"))
    least = F.lit(lim.passes) if large is None else F.when(large, SETTINGS.large_model_compliance).otherwise(lim.passes)
    return _outcome(g, list(keys), 4, F.col("n"), F.col("rate"), F.col("rate") >= least, N.verdict(F.col("rate"), least, lim.abandon, lim.direction, F.col("n") >= lim.least_n))


def gate5(new_passage: Column, new: Column) -> Column:
    """The new value occurs exactly once."""
    return T.whole_count(new_passage, new) == 1


def gate6(old_passage: Column, new_passage: Column, start: Column, end: Column, new: Column) -> Column:
    """Nothing outside the span changed. Offsets are half-open code points from 0."""
    return F.concat(F.substring(old_passage, F.lit(1), start), new, F.substring(old_passage, end + 1, F.char_length(old_passage))) == new_passage


def gate7(cooccurrences: Column, human_ok: Column | None = None) -> Column:
    return (cooccurrences == 0) & (F.lit(True) if human_ok is None else human_ok)


def kappa(pairs: DataFrame, *keys: str) -> DataFrame:
    """Cohen's kappa of x and y, from the contingency table alone; 1 where chance agreement is 1."""
    keys_ = list(keys)
    cells = pairs.groupBy(*keys_, "x", "y").agg(F.count("*").alias("c"))
    sides = cells.select(*keys_, F.explode(F.array(F.struct(F.col("x").alias("v"), F.col("c").alias("cx"), F.lit(0).cast("long").alias("cy")), F.struct(F.col("y").alias("v"), F.lit(0).cast("long").alias("cx"), F.col("c").alias("cy")))).alias("s")).select(*keys_, "s.*")
    chance = sides.groupBy(*keys_, "v").agg(F.sum("cx").alias("cx"), F.sum("cy").alias("cy")).groupBy(*keys_).agg(F.sum(F.col("cx").cast("double") * F.col("cy")).alias("pp"))
    seen = cells.groupBy(*keys_).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("agree"))
    both = seen.join(chance, keys_) if keys_ else seen.join(F.broadcast(chance))
    po, pe = F.col("agree") / F.col("n"), F.col("pp") / (F.col("n").cast("double") * F.col("n"))
    k = F.when(pe >= 1, F.lit(1.0)).otherwise(F.try_divide(po - pe, 1 - pe))
    return both.select(*keys_, "n", (F.col("n") - F.col("agree")).alias("conflicts"), F.round(k, 9).alias("kappa"), (k >= SETTINGS.kappa_min).alias("passed"))
