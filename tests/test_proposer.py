"""Spans, borrowed and invented values, proposals and their outcomes."""

import random
import re

from pyspark.sql import functions as F

from veritrace.operators import pool as P
from veritrace.operators import proposer as PR

GOLD = "question_id string, multi boolean, ord int, doc_id string, title string, text string, answers array<string>, kind string, support array<string>"


def gold(spark, *rows):
    return spark.createDataFrame(list(rows), GOLD)


def number_pool(spark, *values):
    return P.build_pool(spark.createDataFrame([(k, "numeric", v) for k, v in enumerate(values)], "ord int, kind string, value string"))


def test_spans_are_rows(spark):
    rows = spark.createDataFrame([("a", "Paris, Parisian and 2 of 12", ["Paris", "2", "ian"]), ("b", None, ["x"]), ("c", "x", None), ("d", "", [])], "id string, t string, v array<string>")
    got = sorted((r.id, r.start, r.end, r.value) for r in PR.spans(rows, "t", "v").collect())
    assert got == [("a", 0, 5, "Paris"), ("a", 12, 15, "ian"), ("a", 20, 21, "2")]


def test_ranks_do_not_depend_on_chunks(spark, monkeypatch):
    pool = spark.createDataFrame([(b, f"v{k}", k // 3) for b, n in (("x", 100), ("y", 7)) for k in range(n)], "bucket string, value string, ord int")
    want = {(b, v): k for b, n in (("x", 100), ("y", 7)) for k, v in enumerate(sorted((f"v{k}" for k in range(n)), key=lambda v: (int(v[1:]) // 3, v)))}
    for chunk in (PR.CHUNK, 8):
        monkeypatch.setattr(PR, "CHUNK", chunk)
        assert {(r.bucket, r.value): r["rank"] for r in PR.ranked(pool).collect()} == want


def test_borrowed_picks_what_the_pairwise_form_picks(spark):
    r = random.Random(4)
    years = [str(r.randint(1800, 2020)) for _ in range(60)]
    numbers = [str(r.randint(1, 99)) for _ in range(40)]
    answers = [(k, "date", v) for k, v in enumerate(years)] + [(k, "numeric", v) for k, v in enumerate(numbers)]
    answers = spark.createDataFrame(answers, "ord int, kind string, value string")
    rows = [(k, f"d{k}", kind, old, " ".join(r.choices(years + numbers, k=12))) for k in range(80) for kind, old in [r.choice([("date", r.choice(years)), ("numeric", r.choice(numbers))])]]
    targets = spark.createDataFrame(rows, "question_id int, doc_id string, kind string, old string, passage string")
    for strict in (False, True):
        pool = P.build_pool(answers, strict)
        want = {(x.question_id, x.new, x.bucket, x.n_candidates) for x in P.borrow(targets.drop("doc_id"), pool, strict).collect()}
        got = {(x.question_id, x.new, x.bucket, x.n_candidates) for x in PR.borrowed(targets, pool, strict).collect()}
        assert got == want and len(got) == 80


def test_invented_values_are_new_to_the_passage(spark):
    rows = [("date", "1990", "in 1983, 1985 or 1995"), ("numeric", "57", "57 of 60"), ("numeric", "5", " ".join("123456789")), ("name", "Bo", "Bo"), ("date", "May 1", "x"), (None, None, None)]
    got = [r.v for r in spark.createDataFrame(rows, "k string, o string, p string").select(PR.invented(F.col("k"), F.col("o"), F.col("p")).alias("v")).collect()]
    assert got[0] == "1997" and len(got[1]) == 2 and got[1] not in ("57", "60") and got[2:] == [None] * 4


def outcome(spark, rows, values=("41", "42", "43"), said=None):
    made = PR.proposals(gold(spark, *rows), number_pool(spark, *values), said)
    return {r.doc_id: r for r in made.collect()}, {r.question_id: (r.status, r.reason, r.n_proposals, r.n_skipped) for r in PR.outcomes(made).collect()}


SINGLE = [
    ("once", False, 0, "once", "t", "It was 57 then.", ["57"], "numeric", []),
    ("twice", False, 0, "twice", "t", "It was 57, yes 57.", ["57"], "numeric", []),
    ("none", False, 0, "none", "t", "It was.", ["57"], "numeric", []),
    ("null", False, 0, "null", None, None, None, "numeric", None),
    ("name", False, 0, "name", "t", "It was Bo.", ["Bo"], "name", []),
    ("bare", False, 0, "bare", "t", "It was 5.", ["5"], "numeric", []),
]


def test_questions_of_one_step(spark):
    rows, ends = outcome(spark, SINGLE)
    assert ends == {
        "once": ("auto", "", 1, 0), "twice": ("llm_disambig", "first_of_several", 1, 0), "none": ("failed", "no_hit", 0, 0),
        "null": ("failed", "no_hit", 0, 0), "name": ("failed", "no_value", 0, 0), "bare": ("auto", "", 1, 0),
    }
    assert rows["once"].new in ("41", "42", "43") and (rows["once"].start, rows["once"].end, rows["once"].role) == (7, 9, "terminal")
    assert rows["twice"].start == 7 and rows["bare"].new != "5" and len(rows["bare"].new) == 1  # no number of one digit in the pool


def test_chains_end_at_the_last_support_with_the_answer(spark):
    def chain(q, texts, support, titles="abc"):
        return [(q, True, k, f"{q}{k}", titles[k], t, ["57"], "numeric", list(support)) for k, t in enumerate(texts)]

    rows, ends = outcome(spark, chain("p", ["57 here", "57 there", "none"], "bac") + chain("q", ["no", "no", "no"], "abc") + chain("r", ["57", "57", "no"], ""))
    assert ends == {"p": ("auto", "", 2, 1), "q": ("failed", "no_proposal", 0, 3), "r": ("auto", "", 2, 1)}
    assert [rows[f"p{k}"].role for k in range(3)] == ["terminal", "bridge_sync", None] and rows["r1"].role == "terminal"
    same = chain("s", ["57", "57"], "a", titles="aa")
    assert outcome(spark, same)[1] == {"s": ("auto", "", 2, 0)}  # by id one end
    none = spark.createDataFrame([], "question_id string, doc_id string, raw string")
    assert outcome(spark, same, said=none)[1] == {"s": ("failed", "terminal_not_unique", 0, 0)}  # by title two


def test_a_model_decides_where_the_text_does_not(spark):
    asked = {r.doc_id for r in PR.prompts(gold(spark, *SINGLE)).collect()}
    assert asked == {"twice", "none", "null"}
    said = [("twice", "twice", 'Sure: {"char_span": [15, 17], "old": "57"}'), ("none", "none", '{"char_span": [0, 2], "old": "57"}'), ("null", "null", "no")]
    rows, ends = outcome(spark, SINGLE, said=spark.createDataFrame(said, "question_id string, doc_id string, raw string"))
    assert ends["twice"] == ("llm_disambig", "", 1, 0) and (rows["twice"].start, rows["twice"].end) == (15, 17)
    assert ends["none"] == ("failed", "not_verbatim", 0, 0) and ends["null"] == ("failed", "no_value", 0, 0) and ends["once"] == ("auto", "", 1, 0)


def test_ledger_and_empty_tables(spark):
    made = PR.outcomes(PR.proposals(gold(spark, *SINGLE), number_pool(spark, "41", "42")))
    got = {(r.status, r.reason): (r.n, r.mean_seconds) for r in PR.ledger(made.withColumn("s", F.lit(2.0)), seconds="s").collect()}
    assert got[("failed", "no_hit")] == (2, 2.0) and sum(n for n, _ in got.values()) == 6
    assert PR.outcomes(PR.proposals(gold(spark), number_pool(spark, "41"))).count() == 0


def test_values_of_one_word_need_no_automaton(spark, monkeypatch):
    """Before, every value was a pattern, so each passage was read once for each block of the pool."""
    sought = []
    real = PR.M.occurring
    monkeypatch.setattr(PR.M, "occurring", lambda texts, text, patterns, *more: sought.extend(r.value for r in patterns.collect()) or real(texts, text, patterns, *more))
    pool = spark.createDataFrame([("b", v, i) for i, v in enumerate(["12", "34", "5.6", "é7", "78"])], "bucket string, value string, ord int")
    monkeypatch.setattr(PR.P, "ladder", lambda kind, old, strict: F.array(F.struct(F.lit(0).alias("prio"), F.lit("b").alias("bucket"))))
    targets = spark.createDataFrame([(1, 1, "numeric", "12", "12 and 5.6, 134 34x é7"), (2, 2, "numeric", "12", "12, 34; 78")], "question_id int, doc_id int, kind string, old string, passage string")
    got = {r.question_id: (r.old, r.new, r.n_candidates) for r in PR.borrowed(targets, pool).collect()}
    assert sorted(sought) == ["5.6", "é7"]
    assert got[1][0] == "12" and got[1][1] in ("34", "78") and got[1][2] == 2 and got[2][1] in ("5.6", "é7") and got[2][2] == 2


def drawn_gold(spark):
    r = random.Random(11)
    values = [str(r.randint(1, 99)) for _ in range(30)] + ["5.6", "7,1", "88.0"]
    years = [str(r.randint(1800, 2020)) for _ in range(30)]
    answers = [(k, "numeric", v) for k, v in enumerate(values)] + [(k, "date", v) for k, v in enumerate(years)] + [(k, "name", v) for k, v in enumerate(["Bo", "Al Li", "Cy"])]
    rows = []
    for q in range(60):
        kind, own = r.choice([("numeric", values), ("date", years), ("name", ["Bo", "Al Li", "Zed"])])
        answer, multi = r.choice(own), q % 3 == 0
        for k in range(3 if multi else 1):
            words = r.choices(values + years + ["Bo", "Al Li", "Cy"], k=8) + ([answer] if r.random() < 0.8 else [])
            rows.append((f"q{q}", multi, k, f"q{q}-{k}", r.choice("abc"), " ".join(words), [answer], kind, ["a", "c"]))
    return gold(spark, *rows), spark.createDataFrame(answers, "ord int, kind string, value string")


def test_small_buckets_give_what_the_joins_give(spark, monkeypatch):
    """Before, every passage went through the joins, with its text and a row for each of its words."""
    rows, answers = drawn_gold(spark)
    real = PR.borrowed
    for strict in (False, True):
        pool, got, joined = P.build_pool(answers, strict), {}, {}
        for small in (0, 12, PR.SMALL):
            monkeypatch.setattr(PR, "SMALL", small)
            monkeypatch.setattr(PR, "borrowed", lambda targets, *more: joined.__setitem__(small, targets.count()) or real(targets, *more))
            made = PR.proposals(rows, pool, strict_era=strict).drop("spans")
            got[small] = sorted(map(str, made.collect()))
            monkeypatch.undo()
        assert got[0] == got[12] == got[PR.SMALL] and len(got[0]) == 100
        assert joined[0] > joined[12] > 0 == joined[PR.SMALL]


def by_passage(spark, name):
    """Whether a query's plan, as run, deals rows by passage: the joins of `borrowed`."""
    from veritrace.plans import registry

    made = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    made.collect()
    ran = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return re.search(r"hashpartitioning\(question_id#\d+, doc_id#", ran) is not None


def test_ledger_deals_no_rows_by_passage(spark):
    assert not by_passage(spark, "proposal_ledger")


def test_proposals_deal_no_rows_by_passage(spark):
    assert not by_passage(spark, "proposals")
