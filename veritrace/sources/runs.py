"""Artifacts of runs, reconciled inside the plan: what disagrees fails the query that reads it, and no job of its own checks it.

Each check is a column that raises where a row breaks it, so files are read once, and the checks run where the rows are joined.
`gaps` lists what disagrees instead of failing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.fourarm import ARMS
from . import readers as R

#: What a run may hold: name of the output, and its schema.
OUTPUTS = {"oracle": R.ORACLE, "arms": R.FOURARM, "substituted": R.SUBSTITUTED, "memory": R.MEMSTRENGTH, "swap": R.EVSWAP}


def _together(sides: dict[str, DataFrame]) -> DataFrame:
    """question_id, and for each side its number of rows `n_<side>` and one of them. A full outer join by one shuffle: all sides are rows of one union."""
    parts = []
    for name, rows in sides.items():
        row = F.struct(*rows.columns)
        own = [(row if other == name else F.lit(None).cast(r.select(F.struct(*r.columns).alias("x")).schema["x"].dataType)).alias(other) for other, r in sides.items()]
        parts.append(rows.select("question_id", *own, F.lit(name).alias("side")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("question_id").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in sides], *[F.first(s, ignorenulls=True).alias(s) for s in sides])


def _faults(sides: list[str]) -> Column:
    """What is wrong with an item, in words; null where nothing is."""
    said = [F.when(F.col(f"n_{s}") == 0, F.lit(f"{s} lacks it")).when(F.col(f"n_{s}") > 1, F.lit(f"{s} repeats it")) for s in sides]
    both = [s for s in ("oracle", "arms") if s in sides]
    if len(both) == 2:
        recorded, kept = F.col("oracle.arms_em"), F.col("arms")
        same = reduce(lambda x, y: x & y, [recorded[a].eqNullSafe(kept[a]) for a in ARMS])
        said.append(F.when((F.col("n_oracle") > 0) & (F.col("n_arms") > 0) & F.col("oracle.arms_em").isNotNull() & ~same, F.lit("arms differ from those recorded")))
    if "arms" in sides:
        binary = reduce(lambda x, y: x & y, [F.coalesce(F.col("arms")[a].isin(0, 1), F.lit(False)) for a in ARMS])
        said.append(F.when((F.col("n_arms") > 0) & ~binary, F.lit("arms are not 0 or 1")))
    if "substituted" in sides:
        key = F.coalesce(F.trim("substituted.new_key"), F.lit(""))
        said.append(F.when((F.col("n_substituted") > 0) & (key == ""), F.lit("the edit has no new key")))
    text = F.array_join(F.array_compact(F.array(*said)), ", ")
    return F.when(F.col("question_id").isNull(), F.lit("no question_id")).when(text != "", text)


def read(spark: SparkSession, folder: str, label: str, *names: str) -> dict[str, DataFrame]:
    """The named outputs of a run, each under its schema."""
    return {n: R.json_lines(spark, f"{folder}/run_label={label}/{n}", OUTPUTS[n]) for n in names}


def gaps(sides: dict[str, DataFrame]) -> DataFrame:
    """question_id and fault of each item on which the sides disagree."""
    return _together(sides).select("question_id", _faults(list(sides)).alias("fault")).where("fault IS NOT NULL")


def reconciled(sides: dict[str, DataFrame]) -> DataFrame:
    """question_id and a struct for each side. Reading it fails unless every side has the same items, each once, arms are 0 or 1
    and, where the oracle's rows record arms, equal to those; sides: name -> rows, names as in OUTPUTS."""
    rows = _together(sides).withColumn("fault", _faults(list(sides)))
    # the key itself carries the check, so no column can be read without it
    key = F.when(F.col("fault").isNull(), F.col("question_id")).otherwise(F.raise_error(F.concat(F.lit("item "), F.coalesce("question_id", F.lit("?")), F.lit(": "), F.col("fault"))))
    return rows.select(key.alias("question_id"), *sides).where("question_id IS NOT NULL")


def fingerprinted(rows: DataFrame, name: str = "items") -> tuple[DataFrame, Observation]:
    """The rows, and what is seen of them as they are read: their number, and a sum of hashes that tells one set of keys from another in any order."""
    seen = Observation(name)
    hashed = F.sum(F.xxhash64("question_id").cast("decimal(38,0)"))
    return rows.observe(seen, F.count("*").alias("n"), hashed.cast("string").alias("keys")), seen


def space(cells: dict[str, DataFrame]) -> DataFrame:
    """question_id, cell, a, b, c, d, passed_gates over a declared space of cells. Reading it fails unless all cells have the same items, each once,
    and an item's closed-book arms are the same in all of them.

    An item's cells are as many as were declared, so they are a list of its own."""
    parts = [rows.select("question_id", F.lit(name).alias("cell"), *ARMS, "passed_gates") for name, rows in cells.items()]
    rows = reduce(DataFrame.unionByName, parts)
    each = F.struct("cell", *ARMS, "passed_gates")
    one = rows.groupBy("question_id").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("held"), F.count_distinct(F.coalesce("a", F.lit(-1))).alias("va"), F.count_distinct(F.coalesce("c", F.lit(-1))).alias("vc"), F.collect_list(each).alias("cells"))
    fault = F.when((F.col("held") != len(cells)) | (F.col("n") != len(cells)), F.lit("cells differ in their items")).when((F.col("va") > 1) | (F.col("vc") > 1), F.lit("closed-book arms differ between cells")).when(F.col("question_id").isNull(), F.lit("no question_id"))
    key = F.when(fault.isNull(), F.col("question_id")).otherwise(F.raise_error(F.concat(F.lit("item "), F.coalesce("question_id", F.lit("?")), F.lit(": "), fault)))
    return one.select(key.alias("question_id"), F.explode("cells").alias("x")).select("question_id", "x.*").where("question_id IS NOT NULL")


def memory_pairs(rows: DataFrame) -> DataFrame:
    """Gains, masking and cost of each item beside its log-probabilities, for items with one for the old answer. rows: reconciled(), with arms and memory."""
    a, b, c, d = (F.col("arms")[x] for x in ARMS)
    old, new = F.col("memory.lp.old"), F.col("memory.lp.new")
    kept = rows.where(old["mean_lp"].isNotNull())
    return kept.select(
        "question_id", F.col("memory.model").alias("model"), F.col("memory.dataset").alias("dataset"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), (b - a).alias("apparent"), (d - c).alias("corrected"),
        ((d - c) - (b - a)).alias("masking"), (b - d).alias("cost"), old["mean_lp"].alias("lp_old_mean"), old["sum_lp"].alias("lp_old_sum"), old["first_lp"].alias("lp_old_first"), new["mean_lp"].alias("lp_new_mean"), F.col("memory.margin_mean").alias("margin_mean"),
    )
