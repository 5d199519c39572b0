"""Runs over a grid of models, depths and budgets, from one ranked retrieval.

A depth's hits are a prefix of the deepest ranking and a budget's context a prefix of a depth's, so questions are searched
once for the whole grid. Each finished cell is a folder of its own with its arms, a row of audit for each item, a summary and
a manifest; a run that is started again passes over the cells that have all of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import sinks as K
from . import arms as X
from . import fourarm as A


@dataclass(frozen=True)
class Cell:
    model: str
    k: int
    budget: int

    @property
    def key(self) -> str:
        return f"k={self.k};budget={self.budget}"

    @property
    def label(self) -> str:
        return f"{self.model.replace('/', '_')}-k{self.k}-b{self.budget}"


def cells(models: list[str], depths: list[int], budgets: list[int]) -> Iterator[Cell]:
    """Every cell of the grid; all cells of a model follow each other, so its generator is made once."""
    return itertools.starmap(Cell, itertools.product(models, depths, budgets))


def prefixed(ranked: DataFrame) -> DataFrame:
    """The ranking with so_far, the words of each hit and all before it, so that every depth and budget is a filter.

    ranked: question_id, side (orig or sub), rank, text, n_words, is_gold, up to the deepest depth of the grid."""
    w = W.partitionBy("question_id", "side").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranked.withColumn("so_far", F.sum("n_words").over(w))


def contexts(ranked: DataFrame, cell: Cell) -> DataFrame:
    """question_id, side, context, n_docs, has_gold: the hits up to the cell's depth while their words fit its budget; a text that does not fit ends the context. ranked: prefixed()."""
    fits = ranked.where((F.col("rank") <= cell.k) & (F.col("so_far") <= cell.budget))
    hits = F.array_sort(F.collect_list(F.struct("rank", "text")))  # at most k
    one = fits.groupBy("question_id", "side").agg(hits.alias("hits"), F.bool_or("is_gold").alias("has_gold"))
    return one.select("question_id", "side", F.array_join(F.transform("hits", lambda h: h["text"]), "\n").alias("context"), F.size("hits").alias("n_docs"), "has_gold")


def items_of(questions: DataFrame, ranked: DataFrame, cell: Cell) -> DataFrame:
    """Rows for arms.four_arms with the cell's contexts, and what was found of the gold text on each side; a question without hits has empty contexts."""
    c = contexts(ranked, cell)
    of = lambda name, side: F.max(F.when(F.col("side") == side, F.col(name)))
    wide = c.groupBy("question_id").agg(*[of(n, s).alias(f"{s}_{n}") for s in ("orig", "sub") for n in ("context", "n_docs", "has_gold")])
    rows = questions.join(wide, "question_id", "left")
    return rows.fillna("", ["orig_context", "sub_context"]).fillna(0, ["orig_n_docs", "sub_n_docs"]).fillna(False, ["orig_has_gold", "sub_has_gold"])


def audit(items: DataFrame, arms: DataFrame, cell: Cell) -> DataFrame:
    """A row for each item of a cell: what was retrieved, digests of the contexts, outputs and arms."""
    seen = items.select("question_id", *[f"{s}_{n}" for s in ("orig", "sub") for n in ("n_docs", "has_gold")], *[F.md5(f"{s}_context").alias(f"{s}_md5") for s in ("orig", "sub")])
    return arms.join(seen, "question_id").select("question_id", F.lit(cell.model).alias("model"), F.lit(cell.key).alias("config_key"), *seen.columns[1:], "arms_raw", *A.ARMS)


def _finished(spark: SparkSession, folder: str) -> bool:
    """The manifest is written last, so a cell with a whole one is whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def run(questions: DataFrame, ranked: DataFrame, generator_of: Callable[[str], X.Generator], grid: list[Cell], path: str, data: list[str]) -> list[str]:
    """Works through the cells that are not finished; returns the labels of those it ran.

    questions: question_id, question, old, new, old_aliases, passed_gates; ranked: prefixed(), written (it is read for every cell); data: files for the manifest."""
    spark, ran, generators = questions.sparkSession, [], {}
    for cell in grid:
        folder = f"{path}/run_label={cell.label}"
        if _finished(spark, folder):
            continue
        if cell.model not in generators:
            generators = {cell.model: generator_of(cell.model)}
        items = items_of(questions, ranked, cell)
        K.json_lines(audit(items, X.four_arms(items, generators[cell.model]), cell), f"{folder}/audit")
        # what follows reads what was written: a generator is not asked again
        held = spark.read.schema(AUDIT).json(f"{folder}/audit")
        arms = held.join(questions.select(F.col("question_id").cast("string").alias("question_id"), "passed_gates"), "question_id").select("question_id", "model", "config_key", *A.ARMS, "passed_gates")
        K.run_outputs({"arms": arms}, path, cell.label)
        K.run_outputs({"issues": A.issues(arms, cell.key), "summary": A.summary(A.valid(arms), "model", "config_key")}, path, cell.label)
        K.manifest(spark, cell.label, "grid", data, [cell.model], cell.key, {}, {}).write.mode("overwrite").json(f"{folder}/manifest")
        ran.append(cell.label)
    return ran


AUDIT = (
    "question_id STRING, model STRING, config_key STRING, orig_n_docs INT, orig_has_gold BOOLEAN, sub_n_docs INT, sub_has_gold BOOLEAN, orig_md5 STRING, sub_md5 STRING, "
    "arms_raw STRUCT<cb_orig: STRING, cb_sub: STRING, open_orig: STRING, open_sub: STRING>, a INT, b INT, c INT, d INT"
)


def held(spark: SparkSession, path: str, output: str, schema: str) -> DataFrame:
    """An output of all finished cells, with run_label."""
    done = spark.read.option("basePath", path).json(f"{path}/run_label=*/manifest").select("run_label").distinct()
    rows = spark.read.schema(schema + ", run_label STRING").option("mode", "FAILFAST").option("basePath", path).json(f"{path}/run_label=*/{output}")
    return rows.join(F.broadcast(done), "run_label", "left_semi")  # as many rows as cells
