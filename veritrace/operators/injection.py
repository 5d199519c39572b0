"""Evidence units, packing, budget prefixes and context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import text as T


def packed(sentences: Column, block: int = SETTINGS.token_block) -> Column:
    """Blocks of whole sentences of at most `block` tokens; a longer sentence is a block of its own. Each: text, sent_idx of its first sentence, tokens."""
    unit = F.struct(F.lit("").alias("text"), F.lit(0).alias("sent_idx"), F.lit(0).alias("tokens"))
    start = F.struct(F.filter(F.array(unit), lambda _: F.lit(False)).alias("done"), F.lit("").alias("text"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(a: Column, s: Column) -> Column:
        c = T.simple_token_count(s).cast("int")
        full = (a["text"] != "") & (a["n"] + c > block)
        closed = F.when(full, F.concat(a["done"], F.array(F.struct(a["text"].alias("text"), a["first"].alias("sent_idx"), a["n"].alias("tokens"))))).otherwise(a["done"])
        new = full | (a["text"] == "")
        return F.struct(closed.alias("done"), F.when(new, s).otherwise(F.concat_ws(" ", a["text"], s)).alias("text"), F.when(new, a["i"]).otherwise(a["first"]).alias("first"), F.when(full, c).otherwise(a["n"] + c).alias("n"), (a["i"] + 1).alias("i"))

    end = lambda a: F.when(a["text"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["text"].alias("text"), a["first"].alias("sent_idx"), a["n"].alias("tokens")))))
    return F.aggregate(sentences, start, step, end)


def units(passages: DataFrame, granularity: str, text: str = "text") -> DataFrame:
    """unit, sent_idx and tokens of each passage's units; a whole paragraph has sent_idx -1."""
    if granularity == "paragraph":
        return passages.withColumns({"unit": F.col(text), "sent_idx": F.lit(-1), "tokens": T.simple_token_count(text).cast("int")})
    if granularity == "sentence":
        return passages.select("*", F.posexplode(T.sentences(text)).alias("sent_idx", "unit")).withColumn("tokens", T.simple_token_count("unit").cast("int"))
    if granularity == "token256":
        return passages.select("*", F.explode(packed(T.sentences(text))).alias("u")).select("*", F.col("u.text").alias("unit"), F.col("u.sent_idx").alias("sent_idx"), F.col("u.tokens").alias("tokens")).drop("u")
    raise ValueError(f"unknown granularity {granularity!r}")


def budget_prefix(rows: DataFrame, budget: int, partition: str, *order: str) -> DataFrame:
    """Units in order while their tokens fit the budget; the first that does not fit ends the context."""
    w = W.partitionBy(partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def assemble(kept: DataFrame, key: str, *order: str) -> DataFrame:
    """Context of each question: its units joined in order, tokens used and whether gold is among them. kept: is_gold."""
    item = F.struct(*order, "unit")
    return kept.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["unit"]), "\n\n").alias("context"),
        F.sum("tokens").alias("tokens_used"),
        F.count("*").alias("n_units"),
        F.bool_or("is_gold").alias("gold_present"),
    )


def support_recall(present: Column, gold: Column) -> Column:
    """Share of gold facts present; null without gold facts."""
    return F.try_divide(F.size(F.array_intersect(present, gold)).cast("double"), F.size(F.array_distinct(gold)).cast("double"))


def rerank(rows: DataFrame, score: Column, key: str) -> DataFrame:
    """Ranks by a score, ties by the old rank."""
    return rows.withColumn("new_rank", F.row_number().over(W.partitionBy(key).orderBy(score.desc(), "rank")))
