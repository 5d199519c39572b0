"""Generation and scoring of the four arms and the oracle pair, with pluggable generators.

A generator is a function DataFrame -> DataFrame that adds raw_output to rows of
(question_id, arm, question, context, old, new). The stub is a column expression; a model
behind an iterator of batches is wrapped by `from_batches`. Closed-book arms share one prompt.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import numeric as N
from ..functions import text as T

ARMS = (("cb_orig", "a", "old"), ("open_orig", "b", "old"), ("cb_sub", "c", "new"), ("open_sub", "d", "new"))
Generator = Callable[[DataFrame], DataFrame]


def stub(memory: Column | None = None) -> Generator:
    """Says the target where the context has it; without a context, the old answer of items that `memory` marks."""
    known = F.lit(True) if memory is None else memory
    target = F.when(F.col("arm").isin("open_sub", "ora_sub"), F.col("new")).otherwise(F.col("old"))
    said = F.when(F.coalesce("context", F.lit("")) != "", F.when(F.contains("context", target), target).otherwise("unknown")).otherwise(F.when(known, F.col("old")).otherwise("unknown"))
    return lambda rows: rows.withColumn("raw_output", said)


def from_batches(generate: Callable[[Iterator[pd.DataFrame]], Iterator[pd.Series]], chat: Column | bool = False) -> Generator:
    """A generator from a function over the batches of a partition, run by Arrow where the rows are.

    `generate` is called once for a partition, so what it loads is loaded once, and yields the outputs of each batch in turn."""

    def run(rows: DataFrame) -> DataFrame:
        prompts = rows.withColumn("prompt", T.prompt(F.col("question"), F.col("context"), chat))
        schema = ", ".join(f"{c} {t}" for c, t in prompts.dtypes) + ", raw_output string"

        def apply(batches):
            waiting = deque()

            def given():
                for b in batches:
                    waiting.append(b)
                    yield b

            for said in generate(given()):
                b = waiting.popleft()
                yield b.assign(raw_output=pd.Series(said).to_numpy())
            if waiting:
                raise ValueError(f"{len(waiting)} batches have no outputs")

        return prompts.mapInPandas(apply, schema).drop("prompt")

    return run


def four_arms(items: DataFrame, generator: Generator) -> DataFrame:
    """a, b, c, d and the raw outputs. items: question_id, question, old, new, old_aliases, orig_context, sub_context."""
    context = {"cb_orig": F.lit(None).cast("string"), "cb_sub": F.lit(None).cast("string"), "open_orig": F.col("orig_context"), "open_sub": F.col("sub_context")}
    rows = items.withColumn("x", F.explode(F.array(*[F.struct(F.lit(arm).alias("arm"), F.lit(key).alias("key"), context[arm].alias("context")) for arm, key, _ in ARMS]))).select("question_id", "question", "old", "new", "old_aliases", "x.*")
    said = generator(rows)
    gold = F.when(F.col("key").isin("a", "b"), F.col("old_aliases")).otherwise(F.array("new"))
    scored = said.withColumn("em", T.em_any("raw_output", gold))
    of = lambda c, k: F.max(F.when(F.col("key") == k, F.col(c)))
    return scored.groupBy("question_id").agg(*[of("em", k).alias(k) for _, k, _ in ARMS], F.struct(*[of("raw_output", k).alias(arm) for arm, k, _ in ARMS]).alias("arms_raw"))


def oracle_pair(items: DataFrame, generator: Generator) -> DataFrame:
    """em_orig, em_sub and the class of the edited answer, with gold evidence as the context. items: question_id, question, old, new, old_aliases, gold_orig, gold_sub."""
    rows = items.withColumn("x", F.explode(F.array(F.struct(F.lit("ora_orig").alias("arm"), F.col("gold_orig").alias("context")), F.struct(F.lit("ora_sub").alias("arm"), F.col("gold_sub").alias("context")))))
    said = generator(rows.select("question_id", "question", "old", "new", "old_aliases", "gold_sub", "x.*"))
    raw = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("raw_output")))
    one = said.groupBy("question_id").agg(raw("ora_orig").alias("ora_orig"), raw("ora_sub").alias("ora_sub"), F.first("old_aliases").alias("old_aliases"), F.first("new").alias("new"), F.first("gold_sub").alias("gold_sub"))
    new = F.array("new")
    return one.select("question_id", "ora_orig", "ora_sub", T.em_any("ora_orig", F.col("old_aliases")).alias("em_orig"), T.em_any("ora_sub", new).alias("em_sub"), T.classify_output(F.col("ora_sub"), new, F.col("old_aliases")).alias("cls_sub"), (T.whole_count("gold_sub", "new") > 0).alias("term_present"))


def rescored(rows: DataFrame) -> DataFrame:
    """One row for each item and scope (v3, contain, val) with the arms scored anew from raw outputs. rows: question_id, arms_raw, old_aliases, new_aliases."""
    scopes = {"v3": lambda raw, al: T.em_any(raw, al), "contain": T.contain_any, "val": T.value_any}
    made = [F.struct(F.lit(s).alias("scope"), *[f(F.coalesce(F.col(f"arms_raw.{arm}"), F.lit("")), F.col(f"{side}_aliases")).alias(key) for arm, key, side in ARMS]) for s, f in scopes.items()]
    return rows.select("question_id", F.explode(F.array(*made)).alias("x")).select("question_id", "x.*")


def compliance(rows: DataFrame, *keys: str) -> DataFrame:
    """Strict and lenient compliance, and the kinds of outputs that fail strictly. rows: raw, new_aliases, old_aliases."""
    strict = T.classify_output(F.col("raw"), F.col("new_aliases"), F.col("old_aliases"))
    kind = T.categorize(F.col("raw"), F.col("new_aliases"), F.col("old_aliases"))
    r = rows.select(*keys, strict.alias("strict"), kind.alias("kind"))
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    return r.groupBy(*keys).agg(F.count("*").alias("n"), share(F.col("strict") == "new").alias("strict_new"), share(F.col("kind") == "new").alias("lenient_new"), *[F.count_if((F.col("kind") == k) & (F.col("strict") != "new")).alias(f"n_{k}") for k in ("empty", "new", "old", "refusal", "other")])


def hit_tags(hits: DataFrame) -> DataFrame:
    """What each hit is: gold, holder of the new key, holder of an old alias. hits: doc_id, gold_id, text, new, old_aliases."""
    return hits.withColumns({"is_gold": F.col("doc_id") == F.col("gold_id"), "has_new": T.whole_count("text", "new") > 0, "has_old": T.contain_any(F.col("text"), F.col("old_aliases")) == 1, "chars": F.char_length("text"), "snippet": F.substring("text", 1, 120)})


VERDICT = r"(?im)^\s*VERDICT\s*:\s*(yes|no)\s*$"


def span_verdict(raw: Column) -> Column:
    """yes or no from a line of its own, else null."""
    v = F.lower(F.regexp_extract(F.coalesce(raw, F.lit("")), VERDICT, 1))
    return F.when(v != "", v)


@F.pandas_udf(StringType())
def first_json_object(raw: pd.Series) -> pd.Series:
    """The first balanced {...} of a text, quotes and escapes heeded; null if there is none."""

    def find(t):
        start = (t or "").find("{")
        while start >= 0:
            depth, inside, k = 0, False, start
            while k < len(t):
                c = t[k]
                if inside:
                    if c == "\\":
                        k += 1
                    elif c == '"':
                        inside = False
                elif c == '"':
                    inside = True
                elif c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                    if not depth:
                        return t[start : k + 1]
                k += 1
            start = t.find("{", start + 1)
        return None

    return raw.map(find)


def parsed_proposal(raw: Column, passage: Column) -> Column:
    """A model's proposal, kept only where the passage has the old value at its span."""
    p = F.from_json(first_json_object(raw), "start INT, end INT, old STRING, new STRING")
    return F.when(F.substring(passage, p["start"] + 1, p["end"] - p["start"]) == p["old"], p)


def swap_contexts(candidates: DataFrame) -> DataFrame:
    """As many non-gold paragraphs as there are gold ones for each question: those without an alias first, then by rank. candidates: question_id, doc_id, rank, is_gold, dirty."""
    from pyspark.sql import Window as W

    n = candidates.groupBy("question_id").agg(F.count_if("is_gold").alias("n_gold"))
    pick = candidates.where("NOT is_gold").withColumn("r", F.row_number().over(W.partitionBy("question_id").orderBy("dirty", "rank", "doc_id")))
    return pick.join(n, "question_id").where("r <= n_gold").select("question_id", "doc_id", "rank", "dirty", "n_gold")


def memory_margin(lp_new: Column, lp_old: Column) -> Column:
    return lp_old - lp_new


def total_vram(rows: DataFrame) -> DataFrame:
    """Memory of each model and whether it fits 8 GB. rows: model, params_b, bits, ctx."""
    need = N.vram_gb(F.col("params_b"), F.col("bits"), F.col("ctx"))
    return rows.select("*", F.round(need, 2).alias("total_gb"), (need <= 8).alias("fits_8gb"))
