"""Corpora of questions and the stored index against plain loops."""

import math
import random
import re

from pyspark.sql import functions as F

from veritrace.operators import corpora as C
from veritrace.operators import postings
from veritrace.operators.postings import Index

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa mu nu xi pi rho tau".split()


def plain(query, docs, k):
    """docs: {id: text}: best k by BM25 with the idf that is never negative."""
    tokens = {i: [w for w in re.split("[^a-z0-9]+", t.lower()) if w] for i, t in docs.items()}
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    score = dict.fromkeys(docs, 0.0)
    for w in re.split("[^a-z0-9]+", query.lower()):
        df = sum(w in t for t in tokens.values())
        for i, t in tokens.items():
            tf = t.count(w)
            score[i] += math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean)) if w else 0
    best = sorted(((-round(s, 8), i) for i, s in score.items() if s > 0))[:k]
    return [(i, round(-s, 6)) for s, i in best]


def texts(seed, n, fade=0.5):
    r = random.Random(seed)
    return {i: " ".join(r.choices(WORDS, [fade**k for k in range(len(WORDS))], k=r.randrange(3, 30))) for i in range(n)}


def test_question_corpora_are_those_of_rebuilt_indexes(spark):
    docs = texts(1, 80, 0.8)
    docs[5], docs[6] = docs[4], "The Mu, a rho!"
    asked = {10: ("alpha mu mu", ["mu"], 4, "edited alpha mu mu"), 11: ("rho tau", ["The Rho", ""], 6, ""), 12: ("nothing", ["absent"], 7, "nothing at all"), 13: ("zeta eta", ["nu"], 8, docs[8] + " zeta zeta")}
    questions = spark.createDataFrame([(q, *x) for q, x in asked.items()], "query_id int, question string, aliases array<string>, gold_id int, sub_text string")
    df = spark.createDataFrame([*docs.items(), (99, None)], "doc_id int, text string")
    scores = C.paired_scores(questions, df)
    top = C.paired_top_k(scores, 6, 8).collect()
    norm = lambda t: " ".join(w for w in re.sub("[^a-z0-9 ]", "", t.lower()).split() if w not in ("a", "an", "the"))
    for q, (question, aliases, gold, sub) in asked.items():
        words = [norm(a) for a in aliases if norm(a)]
        own = {i: t for i, t in docs.items() if i == gold or (t != docs[gold] and not any(re.search(rf"\b{a}\b", norm(t)) for a in words))}
        assert (len(own) < len(docs)) == (q != 12)
        for side, corpus in (("orig", own), ("sub", own | {gold: sub})):
            got = [(r.doc_id, round(r.score, 6)) for r in sorted((r for r in top if (r.query_id, r.side) == (q, side)), key=lambda r: r["rank"])]
            assert got == plain(question, corpus, 6), (q, side)
    ranks = {r.query_id: (r.orig_rank, r.sub_rank) for r in C.paired_gold_ranks(C.paired_top_k(scores, 6, 8), questions).collect()}
    assert ranks[12] == (None, 1) and ranks[10][1] == 1 and set(ranks) == set(asked)


def test_best_of_questions_are_those_of_all_pairs_and_few_rows_are_made(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_DOCS", 16)
    monkeypatch.setattr(C, "QUESTIONS_AT_ONCE", 3)
    docs = texts(3, 120, 0.8)
    docs[5], docs[6], docs[7], docs[110] = docs[4], "The Mu, a rho!", "tau alpha: mu-rho", docs[4]
    asked = [(10, "alpha mu mu", ["mu"], 4, "edited alpha mu mu"), (11, "rho tau", ["The Rho", ""], 6, ""), (12, "nothing", ["absent"], 7, "nothing at all"), (13, "zeta eta", ["nu", "tau alpha"], 8, docs[8] + " zeta zeta")]
    asked += [(14, "", ["mu"], 4, "alpha"), (15, "alpha beta gamma", ["mu-rho", "beta gamma", "!"], 9, "beta"), (16, "alpha", ["x"], 5000, "no such document"), (17, "beta gamma delta eps", [], 110, docs[110])]
    questions = spark.createDataFrame(asked, "query_id int, question string, aliases array<string>, gold_id int, sub_text string")
    df = spark.createDataFrame([*docs.items(), (99000, None)], "doc_id int, text string")
    rows = lambda top: sorted((r.query_id, r.side, r["rank"], r.doc_id, round(r.score, 6)) for r in top.collect())
    best = C.paired_best(questions, df, 6, 8)
    assert rows(best) == rows(C.paired_top_k(C.paired_scores(questions, df), 6, 8)) != []
    assert [f.dataType for f in best.select("query_id", "doc_id").schema] == [f.dataType for f in spark.createDataFrame([(1, 1)], "a int, b int").schema]
    none = C.paired_best(questions.where("query_id = 16"), df, 6, 8)
    assert none.collect() == []


def test_index_skips_blocks_and_is_exact_after_edits(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 8)
    docs = texts(2, 300)
    ask = {1: "rho tau xi", 2: "alpha", 3: "mu nu alpha beta", 4: "unknown", 5: "new word"}
    queries = spark.createDataFrame([*ask.items()], "item_id int, text string")
    frame = lambda d: spark.createDataFrame([*d.items()], "doc_id int, text string")

    def same(index, docs):
        top, said = index.search(queries, "item_id", "text", 4, 8)
        rows = top.collect()
        for q, text in ask.items():
            assert [(r.doc_id, round(r.score, 6)) for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])] == plain(text, docs, 4), q
        return {r.query_id: (r.blocks, r.skipped) for r in said.collect()}

    index = Index.built(frame(docs | {1000: None}))
    said = same(index, docs)
    assert said[3][1] > said[3][0] / 3 and 4 not in said, said  # blocks without a rare word cannot reach the fourth score
    changed = {3: "new word", 17: "tau tau tau rho", 500: "xi of a new document", 4: None, 44: ""}
    after = index.upserted(frame(changed))
    now = {i: t for i, t in (docs | changed).items() if t is not None}
    same(after, now)
    again = {3: "alpha again", 500: None, 4: "back: nu"}
    same(after.upserted(frame(again)), {i: t for i, t in (now | again).items() if t is not None})
    same(index, docs)  # the earlier state still stands
    assert after.stats().first().n_docs == len(now) and after.frequencies(spark.createDataFrame([("tau",)], "term string")).first().df == sum("tau" in (t or "").split() for t in now.values())


def test_a_term_of_many_blocks_adds_no_rows_to_what_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_DOCS", 8)
    words = texts(5, 400, 0.9)
    docs = spark.createDataFrame([*words.items(), (7, "rho rho"), (None, "rho")], "doc_id int, text string")
    index = Index.built(docs)
    held = index.postings
    assert held.count() == held.select("segment", "term", "block").distinct().count()  # a block's postings of a term are one row with its maxima
    assert held.where(F.size("posts") != F.col("n")).count() == 0
    queries = spark.createDataFrame([(q, " ".join(WORDS)) for q in range(30)], "item_id int, text string")
    weights = index.weights(queries, "item_id", "text")
    blocks = spark.createDataFrame(index.bounds(weights).where("block is not null").select("query_id", "segment", "block").collect(), "query_id int, segment int, block long")
    plan = index.scores(weights, blocks)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate inline")]
    assert "HashAggregate" in above and "Exchange" not in above, plan[:3000]  # hits are added up where the block is
    assert index.scores(weights, blocks).count() == 30 * 400
