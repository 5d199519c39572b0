"""Operators of the audit on literal cases, and their identities."""

import pytest
from pyspark.sql import functions as F

from veritrace.functions import text as T
from veritrace.operators import fourarm as A
from veritrace.operators import gates as V
from veritrace.operators import injection as I
from veritrace.operators import pool as P
from veritrace.operators import retrieval as R
from veritrace.operators import stats as B
from veritrace.operators import substitute as S

ARM = "question_id int, model string, k int, a int, b int, c int, d int, passed_gates boolean"


def test_sign_convention(spark):
    rows = spark.createDataFrame([(k, "m", 1, 1, 1, 0, 1, True) for k in range(10)], ARM)
    r = A.summary(rows, "model").first()
    assert (r.did, r.masking, r.apparent_gain, r.corrected_gain) == (-1, 1, 0, 1)
    assert A.summary(rows.limit(0)).first().did is None and A.power_table(rows, "model").first().n_2pp == 0


def test_issues(spark):
    rows = spark.createDataFrame([(1, "m", 1, 1, 0, 0, 2, True), (2, "m", 1, 1, 0, 0, None, True), (3, "m", 1, 0, 0, 0, 0, None)], ARM)
    assert {(r.question_id, r.issue) for r in A.issues(rows).collect()} == {(1, "arm d"), (2, "arm d")} and A.valid(rows).count() == 1


def test_gates_with_few_items_are_undecided(spark):
    six = spark.createDataFrame([(True, "new")] * 6, "correct boolean, cls string")
    for r in (V.gate2(six).first(), V.gate4(six).first(), V.gate3(spark.createDataFrame([(1, 1)] * 5, "em_orig int, em_sub int")).first()):
        assert r.passed is None and r.status == r.verdict == "INSUFFICIENT"


def test_residual_and_retention(spark):
    four = spark.createDataFrame([(True, x) for x in ("old", "other", "other", "other")], "correct boolean, cls string")
    assert V.transition_matrix(four).first().residual_old == 0.25
    hits = spark.createDataFrame([(True, True), (True, True), (True, False), (False, False)], "orig_hit boolean, sub_hit boolean")
    r = R.retrieval_table(hits).first()
    assert r.joint == 0.5 and r.retention == pytest.approx(2 / 3)


def test_kappa(spark):
    k = lambda rows: V.kappa(spark.createDataFrame(rows, "x int, y int")).first()
    same = [(1, 1), (0, 0), (1, 1), (0, 0)]
    assert k(same).kappa == 1 and k([(1, 1)] * 3).kappa == 1
    one = k(same[:3] + [(0, 1)])
    assert one.conflicts == 1 and one.kappa < 1


def test_holm(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "config string, p double")
    got = {r.config: (round(r.p_holm, 9), round(r.p_bh, 9)) for r in B.adjusted(t, order="config").collect()}
    assert got == {"a": (0.03, 0.03), "b": (0.06, 0.04), "c": (0.06, 0.04)}


def test_bootstrap_law(spark):
    rows = spark.createDataFrame([(k, "m", 1, k % 2, 1, 0, int(k % 3 > 0), True) for k in range(90)], ARM)
    gains = {"did": A.did()}
    reps = [r.did for r in B.replicate_means(rows, ["model"], list("abcd"), gains, 300, "t").collect()]
    many = [r.did for r in B.multinomial_means(rows, ["model"], list("abcd"), {"did": lambda x: x["b"] - x["a"] - x["d"] + x["c"]}, 2000).collect()]
    import statistics as st

    true = st.mean((1 - k % 2) - int(k % 3 > 0) for k in range(90))
    spread = st.pstdev((1 - k % 2) - int(k % 3 > 0) for k in range(90)) / 90**0.5
    for x in (reps, many):
        assert st.mean(x) == pytest.approx(true, abs=0.02) and st.pstdev(x) == pytest.approx(spread, rel=0.15)


def test_cluster_law_from_counts(spark):
    import statistics as st

    rows = spark.createDataFrame([("m", k // 4 if k < 60 else 90 + k, k % 3 - (k % 5 > 2)) for k in range(80)], "model string, cl int, v int").unionAll(spark.createDataFrame([("m", 7, None)], "model string, cl int, v int"))
    plain = [r.v for r in B.cluster_means(rows, ["model"], "cl", "v", 400, "t").collect()]
    counted = [r.v for r in B.cluster_multinomial_means(rows, ["model"], "cl", "v", 4000).collect()]
    assert len(counted) == 4000
    assert st.mean(counted) == pytest.approx(st.mean(plain), abs=0.03) and st.pstdev(counted) == pytest.approx(st.pstdev(plain), rel=0.15)


def test_draws_of_rows_taken_together_are_each_rows_own():
    import hashlib

    from veritrace.operators import hashdraw as H

    rows = [{"prefix": f"t|{r}|", "lo": lo, "hi": hi, "n": 97} for r in (0, 7, 8, 41) for lo, hi in ((1, 13), (95, 105))]
    drawn = dict(H._drawn(rows, "n"))
    assert [drawn[k].tolist() for k in range(len(rows))] == [[int(hashlib.md5(f"{x['prefix']}{j}".encode()).hexdigest()[:8], 16) % 97 for j in range(x["lo"], x["hi"])] for x in rows]


def drawn_replicates(monkeypatch, spark, name, maker):
    """The number of replicates that a query asks for."""
    from veritrace.plans import registry

    asked, real = [], getattr(B, maker)
    monkeypatch.setattr(B, maker, lambda *more: asked.append(more[-2]) or real(*more[:-2], 2, more[-1]))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    return asked


def test_bootstrap_percentiles_draws_all_resamples(spark, monkeypatch):
    assert drawn_replicates(monkeypatch, spark, "bootstrap_percentiles", "replicate_means") == [10_000]


def test_paired_bootstrap_draws_all_resamples(spark, monkeypatch):
    assert drawn_replicates(monkeypatch, spark, "paired_bootstrap", "replicate_means") == [10_000]


def test_equivalence_test_draws_all_resamples(spark, monkeypatch):
    assert drawn_replicates(monkeypatch, spark, "equivalence_test", "replicate_means") == [10_000]


def test_clustered_bootstrap_draws_all_resamples(spark, monkeypatch):
    assert drawn_replicates(monkeypatch, spark, "clustered_bootstrap", "cluster_means") == [10_000]


def test_full_bootstrap_queries_have_all_resamples(spark):
    from veritrace.config import SETTINGS
    from veritrace.plans import registry

    sf = "/root/testdata/sf0.001"
    for small in ("paired_bootstrap", "bootstrap_percentiles", "equivalence_test", "clustered_bootstrap"):
        few, many = ({r.model: r for r in registry.QUERIES[n](spark, sf).collect()} for n in (small, f"{small}_full"))
        assert few.keys() == many.keys() and all(few[m].ci_low < many[m].ci_high and many[m].ci_low < few[m].ci_high for m in few)
    assert registry.QUERIES["decision_flip_full"](spark, sf).first().replicates == SETTINGS.bootstrap_b
    advice = registry.QUERIES["config_advice_full"](spark, sf).collect()
    assert len(advice) == registry.QUERIES["config_advice"](spark, sf).count()


def test_decision(spark):
    s = lambda p, a, c: spark.range(1).select(B.sensitive(F.lit(p), *map(F.lit, a), *map(F.lit, c)).alias("x")).first().x
    assert s(0.9, (0.10, 0.20), (0.21, 0.30)) and not s(0.9, (0.1, 0.25), (0.21, 0.3)) and not s(0.5, (0.1, 0.2), (0.21, 0.3))


def test_pearson_of_constants_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert d.select(B.pearson(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_overlay(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, doc_id int, score double")
    got = R.overlay(hits([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 1.0)]), hits([(1, 2, 0.5), (1, 9, 2.5)]), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 3.0), (9, 2.5), (3, 1.0)]


def test_restricted_bm25_is_a_rebuilt_index(spark):
    docs = spark.createDataFrame([(k, " ".join(["x y", "y z z", "x z w", "w w y", "x"][k % 5].split() * (1 + k % 3))) for k in range(15)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "x z"), (2, "w y x")], "id int, text string")
    terms, corpus = R.query_terms(q, "id", "text"), docs.select("doc_id", F.size(F.split("text", " ")).alias("dl"))
    out = spark.createDataFrame([(1, 2), (1, 3), (2, 0)], "query_id int, doc_id int")
    fast = R.restricted_scores(terms, R.postings(docs, "doc_id", "text", terms), corpus, out, R.corpus_stats(docs))
    for k in (1, 2):
        left = docs.join(out.where(f"query_id = {k}"), "doc_id", "left_anti")
        slow = R.bm25_scores(terms.where(f"query_id = {k}"), R.postings(left, "doc_id", "text"), R.corpus_stats(left))
        want = {r.doc_id: round(r.score, 9) for r in slow.collect()}
        assert {r.doc_id: round(r.score, 9) for r in fast.where(f"query_id = {k}").collect()} == want


def test_filled_top_k_and_aliases(spark):
    docs = spark.createDataFrame([(0, "nothing"), (1, "The Paris, France"), (2, "parisian")], "doc_id int, text string")
    q = spark.createDataFrame([(7, ["paris"])], "query_id int, aliases array<string>")
    assert [tuple(r) for r in R.excluded_by_alias(q, docs).collect()] == [(7, 1)]
    scores = spark.createDataFrame([(7, 1, 2.0)], "query_id int, doc_id int, score double")
    assert [r.doc_id for r in R.filled_top_k(scores, q, docs, 3).orderBy("rank").collect()] == [1, 0, 2]


def test_dense_blocks(spark):
    import random

    r = random.Random(1)
    v = spark.createDataFrame([(k, [r.random() for _ in range(4)]) for k in range(50)] + [(99, None)], "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 7 = 0")
    one = sorted(map(tuple, R.dense_top_k(v, q, 4).select("query_id", "rank", "doc_id").collect()))
    assert one == sorted(map(tuple, R.dense_top_k(v, q, 4, block_rows=3).select("query_id", "rank", "doc_id").collect())) and len(one) == 32


def test_packing_never_cuts_a_sentence(spark):
    s = [" ".join(["w"] * n) for n in (3, 4, 9, 2, 1)]
    got = spark.range(1).select(I.packed(F.array(*map(F.lit, s)), 8).alias("u")).first().u
    assert [(u.sent_idx, u.tokens) for u in got] == [(0, 7), (2, 9), (3, 3)] and got[0].text == s[0] + " " + s[1]


def test_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 0, 5, "a", True), (1, 1, 9, "b", False), (1, 2, 1, "c", False)], "q int, i int, tokens int, unit string, is_gold boolean")
    r = I.assemble(I.budget_prefix(rows, 8, "q", "i"), "q", "i").first()
    assert (r.context, r.tokens_used, r.gold_present) == ("a", 5, True)
    present = spark.range(1).select(I.support_recall(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("x")).first().x
    assert present == 0.5


def test_borrow_skips_values_in_the_passage(spark):
    answers = spark.createDataFrame([(1, "numeric", "10"), (2, "numeric", "12"), (3, "numeric", "13"), (4, "numeric", "13"), (5, "comparison", "yes")], "ord int, kind string, value string")
    pool = P.build_pool(answers)
    target = spark.createDataFrame([("q", "numeric", "10", "10 with 12")], "question_id string, kind string, old string, passage string")
    assert pool.count() == 3 and P.borrow(target, pool).first().new == "13"


def test_era_ladder(spark):
    answers = spark.createDataFrame([(1, "date", "1999"), (2, "date", "1850"), (3, "date", "2003")], "ord int, kind string, value string")
    target = lambda y: spark.createDataFrame([("q", "date", y, "x")], "question_id string, kind string, old string, passage string")
    pool = P.build_pool(answers, strict_era=True)
    assert P.borrow(target("1981"), pool, strict_era=True).first().new == "1999"
    assert P.borrow(target("1855"), pool, strict_era=True).first().new == "1850" and P.borrow(target("1700"), pool, strict_era=True).first().new in {"1999", "1850", "2003"}


def test_proposals(spark):
    rows = spark.createDataFrame(
        [("born 1815 there", 5, 9, "1815", "1820", "date"), ("1815 or 1815", 0, 4, "1815", "1820", "date"), ("born 1815", 5, 9, "1816", "x", "numeric"), ("ab", 1, 9, "b", "b", "name")],
        "passage string, start int, end int, old string, new string, kind string",
    )
    got = [(r.errors, r.new_passage) for r in S.apply_proposals(rows).collect()]
    assert got == [([], "born 1820 there"), (["unique"], None), (["literal", "unique", "type"], None), (["bounds", "value"], None)] or got[3][0][0] == "bounds" and got[:3] == [([], "born 1820 there"), (["unique"], None), (["literal", "unique", "type"], None)]
    assert {r.reason: r.n for r in S.ledger(S.apply_proposals(rows)).collect()} == {"unique": 1, "literal": 1, "bounds": 1}


def test_edits_are_reversible_and_local(spark):
    rows = spark.createDataFrame([("é 1815 日本", 2, 6, "1820")], "p string, s int, e int, v string")
    new = rows.withColumn("n", S.rewritten(*[F.col(c) for c in "psev"]))
    r = new.select("n", V.gate6(F.col("p"), F.col("n"), F.col("s"), F.col("e"), F.col("v")).alias("ok"), S.changed_span("p", "n").alias("c")).first()
    assert r.n == "é 1820 日本" and r.ok and tuple(r.c) == (4, 6, 6)


def test_spans(spark):
    r = spark.createDataFrame([("Paris, Parisian and 2 of 12", ["Paris", "2", "ian"])], "t string, v array<string>").select(S.find_spans("t", "v").alias("s")).first()
    assert [(x.start, x.end, x.value) for x in r.s] == [(0, 5, "Paris"), (12, 15, "ian"), (20, 21, "2")]


def test_edited_paragraphs(spark):
    p = spark.createDataFrame([(1, 0, "old text"), (1, 1, "other"), (2, 0, "old text")], "question_id int, ord int, text string")
    e = spark.createDataFrame([(1, "old text", "new text")], "question_id int, old_passage string, new_passage string")
    assert {(r.question_id, r.ord): r.text for r in S.edited_paragraphs(p, e).collect()} == {(1, 0): "new text", (1, 1): "other", (2, 0): "old text"}


def test_gate4_goes_by_its_own_limit(spark):
    rows = spark.createDataFrame([(m, "new" if k < n else "old") for m, n in (("a", 38), ("b", 35), ("c", 20)) for k in range(40)], "model string, cls string")
    verdicts = lambda df: {r.model: (r.passed, r.verdict) for r in df.collect()}
    assert verdicts(V.gate4(rows, "model")) == {"a": (True, "GO"), "b": (False, "REVISE"), "c": (False, "ABANDON")}
    assert verdicts(V.gate4(rows, "model", large=F.lit(True)))["b"] == (True, "GO")


def test_automaton_finds_every_pattern(spark):
    import random

    from veritrace.operators import automaton as M

    r = random.Random(8)
    word = lambda n: "".join(r.choices("abé", k=n))
    texts = [word(r.randrange(40)) for _ in range(60)] + [None, ""]
    names = sorted({word(r.randrange(1, 5)) for _ in range(50)}) + ["", None]
    t = spark.createDataFrame([*enumerate(texts)], "found_id int, text string").withColumnRenamed("found_id", "id")
    p = spark.createDataFrame([(x,) for x in names], "name string")
    for block in (M.BLOCK_BYTES, 40):  # one block, and several
        rows = M.occurring(t, "text", p, "name", block).select("id", F.explode("found").alias("x")).collect()
        assert sorted((x.id, x.x) for x in rows) == sorted((i, x) for i, text in enumerate(texts) for x in names if x and text and x in text)
    assert M.occurring(t, "text", p.where("false"), "name").count() == 0


def test_cooccurrences_without_nested_loops(spark):
    texts = ["Ann met Bob in Rome", "Bob went to ROME", None, "ann", "Rome Ann", ""]
    pairs = [("Ann", "Rome"), ("Bob", "rome"), ("Bob", "Paris"), ("", "Rome"), ("", ""), ("Ann", "nn")]
    df = P.cooccurrences(spark.createDataFrame(pairs, "subject string, value string"), spark.createDataFrame([(t,) for t in texts], "text string"), block_bytes=6)
    want = {(s, v): sum(t is not None and s.lower() in t.lower() and v.lower() in t.lower() for t in texts) for s, v in pairs}
    assert {(r.subject, r.value): r.n for r in df.collect()} == want
    plan = P.cooccurrences(spark.createDataFrame([p for p in pairs if all(p)], "subject string, value string"), spark.createDataFrame([(t,) for t in texts], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") <= 1  # of the one row that counts all paragraphs


def test_scores_of_a_document_are_added_where_its_postings_are(spark):
    """Before, every pair of query and document was shuffled, and a query's terms met all of its excluded documents."""
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 3} w{i % 5}") for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "alpha w1"), (2, "beta w2 w4")], "query_id long, text string")
    out = spark.createDataFrame([(1, 1), (1, 4), (2, 9)], "query_id long, doc_id long")
    terms, posts = R.query_terms(queries, "query_id", "text"), R.postings(docs, "doc_id", "text")
    corpus = docs.select("doc_id", F.size(T.bm25_tokens("text")).alias("dl"))
    for scores in (R.bm25_scores(terms, posts, R.corpus_stats(docs)), R.restricted_scores(terms, posts, corpus, out, R.corpus_stats(docs))):
        plan = scores._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "hashpartitioning(query_id" in x and "doc_id" in x]
        assert scores.where("query_id = 1").count() in (40, 38)


def test_dense_search_in_small_slices(spark, monkeypatch):
    """A task holds SCORES_AT_ONCE scores and no matrix of all queries and a whole batch."""
    import numpy as np

    x = np.random.default_rng(2).normal(size=(50, 4)).round(3)
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(R, "SCORES_AT_ONCE", 12)
    got = {(r.query_id, r["rank"]): r.doc_id for r in R.dense_top_k(v, v.where("vec_id < 5"), 3).collect()}
    for q in range(5):
        best = np.argsort(-(x @ x[q]), kind="stable")[:3]
        assert [got[q, k] for k in (1, 2, 3)] == best.tolist()
