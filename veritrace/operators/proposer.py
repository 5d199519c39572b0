"""Proposals of edits: where an answer stands, what replaces it, and an outcome for each question.

An outcome goes down ordered steps: literal hit, borrowed value, invented value, and, where a model's answer is at hand, its
span for passages with no or several hits. Failures are rows with a reason, never exceptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import numeric as N
from ..functions import text as T
from . import annotate as AN
from . import arms as X
from . import automaton as M
from . import pool as P
from . import substitute as S

#: Rows of a bucket that one window numbers.
CHUNK = 1 << 16
#: Values of a bucket up to which it is broadcast whole.
SMALL = 1 << 10
#: Tries of an invented number.
TRIES = 100
# Distances of invented years, in the order in which they are tried.
YEAR_STEPS = (-7, -5, 5, 7, 11, -11, 13)


@F.udtf(returnType="start int, end int, value string", useArrow=True)
class LiteralSpans:
    """A table of every place of every value in a text: as whole words, else anywhere, in order."""

    def eval(self, text: str, values: list):
        yield from S._spans_of(text, values)


def spans(rows: DataFrame, text: str, values: str) -> DataFrame:
    """Rows times the places of their values, by a lateral join: start, end (half-open code points from 0), value. Rows without any go."""
    return rows.lateralJoin(LiteralSpans(F.col(text).outer(), F.col(values).outer()))


def ranked(pool: DataFrame) -> DataFrame:
    """bucket, value and rank, from 0, in pool order within the bucket; a bucket of any size is numbered in chunks."""
    placed = AN.global_rank(pool.select("bucket", "value", "ord"), "ord", "value", "bucket").withColumn("chunk", F.floor(F.col("place") / CHUNK))
    before = placed.groupBy("bucket", "chunk").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = before.select("bucket", "chunk", start.alias("before"))
    within = F.row_number().over(W.partitionBy("bucket", "chunk").orderBy("place")) - 1
    return placed.withColumn("within", within).join(before, ["bucket", "chunk"]).select("bucket", "value", (F.col("before") + F.col("within")).alias("rank"))


def borrowed(targets: DataFrame, pool: DataFrame, strict_era: bool = SETTINGS.strict_era) -> DataFrame:
    """A value for each target, as `pool.borrow` picks it, without a pair of target and candidate.

    Only the few values that a target may not take are found: those of letters and digits alone are words of the passage, joined by
    equality; an automaton seeks the rest, so its blocks do not grow with numbers and one-word names.
    The pick is the hash's place among the rest, moved past the ranks of those.
    targets: question_id, doc_id, kind, old, passage. Targets without a value are left out."""
    key = ["question_id", "doc_id"]
    places = ranked(pool)
    words = targets.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("passage", F.lit("([0-9A-Za-z]+)")))).alias("value"))
    longer = pool.where(~F.col("value").rlike(r"\A[0-9A-Za-z]+\z"))
    held = M.occurring(targets.select(*key, "passage"), "passage", longer, "value").select(*key, "passage", F.explode("found").alias("value"))
    held = held.where(T.whole_count("passage", "value") > 0).select(*key, "value")
    barred = words.unionByName(held).unionByName(targets.select(*key, F.col("old").alias("value"))).distinct()
    barred = barred.join(places, "value").groupBy(*key, "bucket").agg(F.array_sort(F.collect_list("rank")).alias("barred"))  # words of one passage
    sizes = pool.groupBy("bucket").agg(F.count("*").alias("size"))
    step = targets.select(*key, "old", F.explode(P.ladder(F.col("kind"), F.col("old"), strict_era)).alias("l")).select(*key, "old", "l.*")
    none = F.array().cast("array<bigint>")
    step = step.join(sizes, "bucket").join(barred, [*key, "bucket"], "left").withColumn("barred", F.coalesce("barred", none))
    step = step.withColumn("n", F.col("size") - F.size("barred")).where("n > 0")
    best = step.groupBy(*key, "old").agg(F.min_by(F.struct("bucket", "n", "barred"), "prio").alias("s")).select(*key, "old", "s.*")
    at = N.hash_mod(F.concat_ws("|", F.col("question_id").cast("string"), "old"), F.col("n"))
    rank = F.aggregate("barred", at.cast("long"), lambda r, b: F.when(b <= r, r + 1).otherwise(r))
    return best.withColumn("rank", rank).join(places, ["bucket", "rank"]).select(*key, "old", F.col("value").alias("new"), "bucket", F.col("n").alias("n_candidates"))


def invented(kind: Column, old: Column, passage: Column) -> Column:
    """A year near the old one, or a number of as many digits, that the passage does not hold; null for all else, names above all."""
    free = lambda xs: F.get(F.filter(xs, lambda v: (v != F.trim(old)) & (T.whole_count(passage, v) == 0)), F.lit(0))
    year = F.trim(old).cast("int")
    years = F.transform(F.array(*map(F.lit, YEAR_STEPS)), lambda d: (year + d).cast("string"))
    digits = F.greatest(F.length(F.regexp_replace(F.regexp_replace(old, "[^0-9]", ""), "^0+", "")), F.lit(1))
    low = F.pow(F.lit(10.0), digits - 1).cast("long")
    tries = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda k: (low + F.pmod(F.xxhash64(old, k), low * 9)).cast("string"))
    return F.when((kind == "date") & F.trim(old).rlike("^[0-9]{4}$"), free(years)).when((kind == "numeric") & F.trim(old).rlike("^[0-9][0-9.,]{0,14}$"), free(tries))


def with_terminal(hits: DataFrame) -> DataFrame:
    """hits with terminal_doc and end_title, the last passage of each question's chain: of those with a hit, the last by the order of support, else the last of all.

    A question of one step has its first passage. hits: question_id, multi, ord, doc_id, title, support, n_hits and more."""
    back = F.array_position(F.reverse(F.coalesce("support", F.array().cast("array<string>"))), F.coalesce("title", F.lit("")))
    known = back > 0
    place = F.when(known, F.size("support") - back).otherwise(F.col("ord").cast("long"))
    of = W.partitionBy("question_id")  # passages of one question
    at = F.when(F.col("n_hits") > 0, F.struct(known.alias("known"), place.alias("place")))
    ends = hits.withColumn("_at", at).drop("support").withColumns({"end_title": F.max_by("title", "_at").over(of), "_first": F.min("ord").over(of)}).drop("_at")
    is_end = F.when(F.col("multi"), F.col("title").eqNullSafe(F.col("end_title"))).otherwise(F.col("ord") == F.col("_first"))
    ends = ends.withColumn("_end", F.coalesce(is_end, F.lit(False))).withColumns({"terminal_doc": F.min_by("doc_id", F.when(F.col("_end"), F.col("ord"))).over(of), "_any": F.bool_or("_end").over(of)})
    return ends.withColumn("end_title", F.when(F.col("_any"), F.col("end_title"))).drop("_first", "_end", "_any")


def small_buckets(pool: DataFrame) -> DataFrame:
    """bucket, its values in pool order, and those that are not of letters and digits alone (odd); of buckets of at most SMALL values."""
    few = pool.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") <= SMALL).select("bucket")
    own = pool.join(F.broadcast(few), "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v"))
    return own.select("bucket", F.col("v.value").alias("values"), F.filter("v.value", lambda v: ~v.rlike(r"\A[0-9A-Za-z]+\z")).alias("odd"))


def near(rows: DataFrame, buckets: DataFrame, strict_era: bool) -> DataFrame:
    """rows with new, as `borrowed` has it, where all buckets that the old value may take from are among `buckets` or empty: a row stays where it is.

    rows: question_id, kind, old (null for none), text."""
    old, text = F.col("old"), F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit("([0-9A-Za-z]+)"))
    out, steps = rows.withColumn("_words", F.when(old.isNotNull(), F.array_append(words, old))), 8 if strict_era else 1
    out = out.withColumn("_ladder", F.when(old.isNotNull(), P.ladder(F.col("kind"), old, strict_era)))
    news = []
    for k in range(steps):
        own = F.broadcast(buckets.select(*[F.col(c).alias(f"_{c}{k}") for c in ("bucket", "values", "odd")]))  # SMALL values for each bucket
        out = out.withColumn(f"_b{k}", F.get("_ladder", F.lit(k))["bucket"]).join(own, F.col(f"_b{k}") == F.col(f"_bucket{k}"), "left")
        held = F.filter(f"_odd{k}", lambda v: F.contains(text, v) & (T.whole_count(text, v) > 0))
        out = out.withColumn(f"_free{k}", F.array_except(f"_values{k}", F.concat("_words", held))).drop(f"_b{k}", f"_bucket{k}", f"_values{k}", f"_odd{k}")
        news.append(F.when(F.size(f"_free{k}") > 0, F.col(f"_free{k}")))
    out = out.withColumn("_free", F.coalesce(*news)).drop("_words", "_ladder", *[f"_free{k}" for k in range(steps)])
    at = N.hash_mod(F.concat_ws("|", F.col("question_id").cast("string"), old), F.size("_free").cast("long"))
    return out.withColumn("new", F.when(F.col("_free").isNotNull(), F.get("_free", at.cast("int")))).drop("_free")


def proposals(gold: DataFrame, pool: DataFrame, said: DataFrame | None = None, strict_era: bool = SETTINGS.strict_era) -> DataFrame:
    """A row for each gold passage: doc_id, start, end, old, new, role, n_hits, step and, where it failed, fault.

    gold: question_id, multi, ord, doc_id, title, text, answers, kind, support. said: question_id, doc_id, raw: a model's
    answers to `prompts`, which decide on passages without a single hit; without it the first hit is taken and marked.
    step is hit, first, model or skipped (a passage of a chain without the answer); fault is no_hit, no_value or not_verbatim.

    Passages whose answers all take from small buckets get their value where they are; only the others go through the joins of `borrowed`.
    What then comes together by question has no text."""
    large = pool.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).agg(F.collect_list("bucket").alias("_large"))  # names of buckets: digits, eras and kinds
    far = F.coalesce(F.exists("answers", lambda a: F.exists(P.ladder(F.col("kind"), a, strict_era), lambda x: F.array_contains("_large", x["bucket"]))), F.lit(False))
    gold = gold.crossJoin(F.broadcast(large)).withColumn("_far", far).drop("_large")
    asks = (F.col("n_hits") > 1) | (F.col("n_hits") == 0) & ~F.col("multi") if said is not None else F.lit(False)
    step = F.when(asks, "model").when(F.col("n_hits") == 1, "hit").when(F.col("n_hits") > 1, "first").when(F.col("multi"), "skipped")
    hit = F.get("spans", F.lit(0))

    def located(rows: DataFrame) -> DataFrame:
        found = rows.drop("_far").withColumn("spans", S.find_spans(F.coalesce("text", F.lit("")), "answers")).withColumn("n_hits", F.size("spans"))
        return found.withColumns({"step": step, "old": F.coalesce(hit["value"], F.when(asks, F.get("answers", F.lit(0)))), "start": hit["start"], "end": hit["end"]}).drop("spans")

    here, away = located(gold.where(~F.col("_far"))), located(gold.where("_far"))
    targets = away.where("step <> 'skipped' AND old IS NOT NULL").select("question_id", "doc_id", "kind", "old", F.col("text").alias("passage"))
    away = away.join(borrowed(targets, pool, strict_era).select("question_id", "doc_id", "new"), ["question_id", "doc_id"], "left")
    out = near(here, small_buckets(pool), strict_era).unionByName(away)
    # a model's passage has its value invented from the question's first answer
    source = F.when(F.col("step") == "model", F.get("answers", F.lit(0))).otherwise(F.col("old"))
    out = out.withColumn("new", F.when(F.col("step") != "skipped", F.coalesce("new", invented(F.col("kind"), source, F.col("text")))))
    verbatim = F.lit(True)
    if said is not None:
        out = out.join(said.select("question_id", "doc_id", "raw"), ["question_id", "doc_id"], "left").withColumn("_p", _spoken(F.col("raw"), F.col("text")))
        model = F.col("step") == "model"
        out = out.withColumns({c: F.when(model, F.col("_p")[c]).otherwise(F.col(c)) for c in ("start", "end", "old")})
        verbatim = ~model | F.col("_p").isNotNull()
    fault = F.when(F.col("step").isNull(), "no_hit").when((F.col("step") != "skipped") & F.col("new").isNull(), "no_value").when(~verbatim, "not_verbatim")
    out = with_terminal(out.withColumn("fault", fault))
    ends = F.col("title").eqNullSafe(F.col("end_title")) if said is not None else F.col("doc_id") == F.col("terminal_doc")
    role = F.when(F.col("step") != "skipped", F.when(ends, "terminal").otherwise("bridge_sync"))
    return out.withColumn("role", role).select("question_id", "multi", "ord", "doc_id", "kind", "text", "start", "end", "old", "new", "role", "n_hits", "step", "fault")


def prompts(gold: DataFrame) -> DataFrame:
    """question_id, doc_id, passage and answers of the passages on which a model has to decide."""
    n = F.size(S.find_spans(F.coalesce("text", F.lit("")), "answers"))
    return gold.where((n > 1) | (n == 0) & ~F.col("multi")).select("question_id", "doc_id", F.col("text").alias("passage"), "answers")


def _spoken(raw: Column, passage: Column) -> Column:
    """The span of a model's answer {"char_span": [start, end], "old": ...}, where the passage has just that there; else null."""
    p = F.from_json(X.first_json_object(raw), "char_span ARRAY<INT>, old STRING")
    start, end = F.get(p["char_span"], F.lit(0)), F.get(p["char_span"], F.lit(1))
    good = (start >= 0) & (start < end) & (end <= F.char_length(passage)) & (S.span_text(passage, start, end) == p["old"])
    return F.when(good, F.struct(start.alias("start"), end.alias("end"), p["old"].alias("old")))


def outcomes(rows: DataFrame) -> DataFrame:
    """status (auto, llm_disambig or failed), reason, and numbers of proposals and of skipped passages for each question.

    The first passage with a fault, in their order, decides; then no proposal at all, then a chain without a single end. rows: of `proposals`."""
    made = F.col("fault").isNull() & (F.col("step") != "skipped")
    q = rows.groupBy("question_id", "multi").agg(
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("ord"))).alias("fault"),
        F.count_if(made).alias("made"),
        F.count_if(made & (F.col("role") == "terminal")).alias("ends"),
        F.count_if(F.col("step") == "skipped").alias("n_skipped"),
        F.coalesce(F.bool_or(F.col("step").isin("first", "model")), F.lit(False)).alias("several"),
        F.coalesce(F.bool_or(F.col("step") == "first"), F.lit(False)).alias("first"),
    )
    failed = F.coalesce("fault", F.when(F.col("made") == 0, "no_proposal").when(F.col("multi") & (F.col("ends") != 1), "terminal_not_unique"))
    q = q.withColumn("failed", failed)
    status = F.when(F.col("failed").isNotNull(), "failed").when(F.col("several"), "llm_disambig").otherwise("auto")
    reason = F.coalesce("failed", F.when(F.col("first"), "first_of_several").otherwise(""))
    count = F.when(F.col("failed").isNotNull(), F.lit(0)).otherwise(F.col("made")).cast("long")
    return q.select("question_id", "multi", status.alias("status"), reason.alias("reason"), count.alias("n_proposals"), F.col("n_skipped").cast("long"))


def ledger(outcome: DataFrame, *keys: str, seconds: str | None = None) -> DataFrame:
    """Questions by status and reason, and the mean seconds that an item took where a column has them."""
    more = [F.avg(seconds).alias("mean_seconds")] if seconds else []
    return outcome.groupBy(*keys, "status", "reason").agg(F.count("*").alias("n"), F.sum("n_proposals").alias("n_proposals"), *more)
