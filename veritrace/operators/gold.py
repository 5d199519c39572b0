"""Gold evidence and answer windows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import text as T
from .retrieval import DOCS_EACH
from .substitute import _spans_of, find_spans

#: Questions that a task and the driver hold at once.
QUESTIONS_AT_ONCE = 4096
# Words that are no content.
STOP = tuple(
    "the a an of to in on for and or with at by from as is are was were be been it its this that these those which who whom whose what when where how why not no do does did have has had will would can could should may might must etc".split()
)


def holds_alias(text: Column, aliases: Column) -> Column:
    """The normalised text holds a normalised alias anywhere; an alias that normalises to '' is in every text."""
    norm = T.normalize_answer(text)
    return F.exists(aliases, lambda a: F.contains(norm, T.normalize_answer(a)))


def single_hop(questions: DataFrame) -> DataFrame:
    """Gold passages: positive ones that hold an alias, or else any that does. questions: id, answers, paragraphs."""
    with_alias = F.filter("paragraphs", lambda p: holds_alias(p["text"], F.col("answers")))
    positive = F.filter(with_alias, lambda p: p["grp"] == "positive_ctxs")
    keys = F.array_sort(F.array_distinct(F.transform(F.filter("answers", lambda a: F.trim(a) != ""), T.normalize_answer)))
    return questions.select(F.col("id").alias("question_id"), F.when(F.size(positive) > 0, positive).otherwise(with_alias).alias("gold"), keys.alias("gold_keys"))


def multi_hop(questions: DataFrame) -> DataFrame:
    """Gold passages by the titles of support facts, and gold sentences by their numbers, in order of title and number."""
    titles = F.transform("support_facts", lambda f: f["title"])
    gold = F.filter("paragraphs", lambda p: F.array_contains(titles, p["title"]))
    pick = lambda f: F.get(F.get(F.filter("paragraphs", lambda p: p["title"] == f["title"]), F.lit(0))["sentences"], f["sent_idx"])
    return questions.select(F.col("id").alias("question_id"), gold.alias("gold"), F.array_compact(F.transform(F.array_sort(F.array_distinct("support_facts")), pick)).alias("gold_sentences"))


def windows(pages: DataFrame, radius: int = 260, least: int = 2, near: int = 90, longest_alias: int = 64) -> DataFrame:
    """Best window of each question: around an alias with at least `least` question words within `near` characters,
    `radius` wide on either side but not into the next alias; ties go to the shorter window, then to page order.

    pages: question_id, page, question, aliases, text. Hits are rows, so a long page is no wide array."""
    low = F.transform(F.filter("aliases", lambda a: F.length(F.trim(a)).between(1, longest_alias)), lambda a: F.lower(F.trim(a)))
    cut = lambda x, s, e: F.substring(x, s + 1, e - s)
    start, end, from_ = F.col("h.start"), F.col("h.end"), F.greatest(F.lit(0), F.col("h.start") - radius)
    # each hit takes what lies around it along, not its page
    hits = pages.withColumn("low", F.lower("text")).select("question_id", "page", "question", "text", "low", F.explode(find_spans("low", F.array_distinct(low))).alias("h"))
    hits = hits.select(
        "question_id", "page", "question", "h.*", F.char_length("text").alias("length"), from_.alias("from"), cut(F.col("text"), from_, end + radius).alias("wide"),
        cut(F.col("text"), F.greatest(F.lit(0), start - near), end + near).alias("local"), F.when(start > 0, F.substring("low", start, F.lit(1))).alias("prior"), F.substring("low", end + 1, F.lit(1)).alias("next"),
    )
    beside = lambda c: F.regexp_like(c, F.lit("^[0-9a-z]$"))
    hits = hits.where(~F.coalesce(beside(F.col("prior")), F.lit(False)) & ~beside(F.col("next")))
    score = F.size(F.array_intersect(F.array_remove(T.content_tokens("local", STOP), F.col("value")), T.content_tokens("question", STOP)))
    hits = hits.withColumn("score", score).drop("question", "local", "prior", "next")
    # a hit with too low a score bounds its neighbours' windows and needs no text for that
    hits = hits.withColumn("wide", F.when(F.col("score") >= least, F.col("wide")))
    w = W.partitionBy("question_id", "page").orderBy("start", "end", "value")
    around = hits.withColumns({"before": F.lag("end").over(w), "after": F.lead("start").over(w)})
    scored = around.where(F.col("score") >= least)
    left = F.greatest(F.col("from"), F.coalesce(F.col("before") + 1, F.lit(0)))
    right = F.least(F.col("length"), F.col("end") + radius, F.coalesce("after", F.col("length")))
    cand = scored.withColumn("window", cut(F.col("wide"), left - F.col("from"), right - F.col("from")))
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), F.char_length("window"), "page", "start", "value"))
    best = cand.withColumn("r", rank).where("r = 1")
    once = F.regexp_count(F.lower("window"), F.concat(F.lit(T.LOWER_EDGE[0]), T.literal(F.col("value")), F.lit(T.LOWER_EDGE[1]))) == 1
    return best.where(once).select("question_id", "page", F.col("value").alias("alias"), "score", "window")


def pages_of(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows for windows(): every question with every page that has the first token of one of its aliases.

    The tokens of all pages are an equi-join key, so no pair without a shared token is made.
    questions: question_id, question, aliases; docs: page, text."""
    tokens = lambda x: F.array_remove(F.split(F.lower(x), "[^0-9a-z]+"), "")
    alias = questions.select("question_id", F.explode("aliases").alias("alias")).where(F.size(tokens("alias")) > 0)
    # an alias without such a token is in reach of no key: its question is held against all pages
    plain = questions.where(F.exists("aliases", lambda a: (F.trim(a) != "") & (F.size(tokens(a)) == 0))).select("question_id").crossJoin(docs.select("page"))
    held = docs.select("page", F.explode(F.array_distinct(tokens("text"))).alias("token"))
    keys = alias.select("question_id", F.get(tokens("alias"), F.lit(0)).alias("token")).distinct()
    pairs = held.join(keys, "token").select("question_id", "page").union(plain).distinct()
    return docs.join(pairs, "page").join(questions, "question_id").select("question_id", "page", "question", "aliases", "text")


def best_windows(questions: DataFrame, docs: DataFrame, radius: int = 260, least: int = 2, near: int = 90, longest_alias: int = 64) -> DataFrame:
    """windows(pages_of(questions, docs)): each page is searched once for all the aliases whose first token it has, whatever the number of questions.

    A task keeps the best hit of each question, by its place; the window is cut from that hit's page. Questions are worked through in blocks of
    QUESTIONS_AT_ONCE. questions: question_id, question, aliases; docs: page, text, one row for each page."""
    cut = lambda x, s, e: F.substring(x, s + 1, e - s)
    docs = docs.where(F.col("text").isNotNull()).select("page", "text")
    low = F.array_distinct(F.transform(F.filter("aliases", lambda a: F.length(F.trim(a)).between(1, longest_alias)), lambda a: F.lower(F.trim(a))))
    asked = questions.select("question_id", T.content_tokens("question", STOP).alias("asked"), low.alias("values")).where(F.size("values") > 0)
    found, blocks = None, max(1, -(-asked.count() // QUESTIONS_AT_ONCE))
    for i in range(blocks):
        each = _best_hits(asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i), docs, radius, least, near)
        found = each if found is None else found.unionByName(each)
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), F.col("right") - F.col("left"), "page", "start", "value"))
    best = found.withColumn("r", rank).where("r = 1").join(docs, "page").withColumn("window", cut(F.col("text"), F.col("left"), F.col("right")))
    once = F.regexp_count(F.lower("window"), F.concat(F.lit(T.LOWER_EDGE[0]), T.literal(F.col("value")), F.lit(T.LOWER_EDGE[1]))) == 1
    return best.where(once).select("question_id", "page", F.col("value").alias("alias"), "score", "window")


def _best_hits(asked: DataFrame, docs: DataFrame, radius: int, least: int, near: int) -> DataFrame:
    """question_id, page, value, start, score, left, right: of each task and question the hit whose window comes first. asked: question_id, asked, values."""
    spark = docs.sparkSession
    rows = asked.collect()  # QUESTIONS_AT_ONCE at most
    of: dict[str, list[int]] = {}
    for q, r in enumerate(rows):
        for v in r["values"]:
            of.setdefault(v, []).append(q)
    token = {v: next(iter(re.findall("[0-9a-z]+", v)), "") for v in of}  # without one, an alias is in reach of no token and sought in all pages
    by_token: dict[str, list[str]] = {}
    for v in sorted(of):
        by_token.setdefault(token[v], []).append(v)
    held = spark.sparkContext.broadcast((of, by_token, [frozenset(r["asked"]) for r in rows], [r["question_id"] for r in rows]))

    def run(batches):
        of, by_token, asked, names = held.value
        best: dict[int, tuple] = {}
        word, alnum = re.compile("[a-z0-9]+"), frozenset("0123456789abcdefghijklmnopqrstuvwxyz")
        for b in batches:
            for page, text, low in zip(*(b.column(c).to_pylist() for c in range(3))):
                own = {*word.findall(low), ""}
                spans = _spans_of(low, [v for t in own.intersection(by_token) for v in by_token[t]])
                hits: dict[int, list] = {}
                for s, e, v in spans:
                    if (s and low[s - 1] in alnum) or low[e : e + 1] in alnum:
                        continue
                    local = frozenset(word.findall(text[max(0, s - near) : e + near].lower()))
                    for q in of[v]:
                        hits.setdefault(q, []).append((s, e, v, len(asked[q] & local) - (v in asked[q] and v in local)))
                for q, mine in hits.items():
                    for k, (s, e, v, score) in enumerate(mine):
                        if score < least or (q in best and -score > best[q][0]):
                            continue
                        left = max(0, s - radius, mine[k - 1][1] + 1 if k else 0)
                        right = max(left, min(len(text), e + radius, mine[k + 1][0] if k + 1 < len(mine) else len(text)))
                        key = (-score, right - left, page, s, v, left, right)
                        if q not in best or key < best[q]:
                            best[q] = key
        out = [(names[q], p, v, s, -score, left, right) for q, (score, _, p, s, v, left, right) in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(7)], schema.names)

    kind = {"question_id": asked.schema["question_id"].dataType, "page": docs.schema["page"].dataType, "value": StringType()}
    schema = StructType([StructField(n, kind.get(n, IntegerType())) for n in ("question_id", "page", "value", "start", "score", "left", "right")])
    kinds = [f.type for f in to_arrow_schema(schema)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // DOCS_EACH)
    return docs.repartition(parts, "page").select("page", "text", F.lower("text").alias("low")).mapInArrow(run, schema)


def negatives(pages: DataFrame, most: int = 5, chars: int = 900) -> DataFrame:
    """Openings of a question's pages that hold no alias, in page order."""
    low = F.lower("text")
    clean = pages.where(~F.exists(F.transform("aliases", lambda a: F.lower(F.trim(a))), lambda a: (a != "") & T.contains_whole(low, a)))
    rank = F.row_number().over(W.partitionBy("question_id").orderBy("page"))
    return clean.withColumn("r", rank).where(F.col("r") <= most).select("question_id", "page", F.substring("text", 1, chars).alias("text"))


def clean_aliases(answer: Column) -> Column:
    """The normalised value first, then the other aliases, blank ones and repeats left out."""
    both = F.concat(F.array(answer["normalized_value"]), F.coalesce(answer["aliases"], F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(F.array_compact(both), F.trim), lambda a: a != ""))


def candidate_pages(results: Column, entities: Column, most: int = 8) -> Column:
    """Title and text of the first pages with a text: search results first, entity pages after."""
    search = F.slice(F.arrays_zip(results["title"].alias("title"), results["search_context"].alias("text")), 1, most)
    wiki = F.arrays_zip(entities["title"].alias("title"), entities["wiki_context"].alias("text"))
    none = F.array().cast("array<struct<title:string,text:string>>")
    keep = lambda xs: F.filter(F.coalesce(xs.cast("array<struct<title:string,text:string>>"), none), lambda p: F.trim(p["text"]) != "")
    return F.slice(F.concat(keep(search), keep(wiki)), 1, most)


def type_slice(questions: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Questions whose first non-blank answer has one of these forms."""
    first = F.get(F.filter("answers", lambda a: F.trim(a) != ""), F.lit(0))
    return questions.where(first.isNotNull() & T.answer_type(first).isin(*kinds))


def funnel(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Rows that pass each step and all before it, from one aggregate."""
    so_far, cols = F.lit(True), []
    for name, step in steps.items():
        so_far = so_far & F.coalesce(step, F.lit(False))
        cols.append(F.count_if(so_far).alias(name))
    return rows.agg(F.count("*").alias("all"), *cols)
