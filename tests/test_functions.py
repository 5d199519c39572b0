"""Text and numeric kernels: literal cases."""

from pyspark.sql import functions as F

from veritrace.functions import numeric as N
from veritrace.functions import text as T
from veritrace.operators import pool as P


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_normalise(spark):
    n = lambda s: one(spark, T.normalize_answer("s"), s=s)
    assert n("The 1815, date") == "1815 date" and n("  An É a the-the ") == "é thethe" and n("") == ""


def test_extract(spark):
    e = lambda s: one(spark, T.extract_answer("s"), s=s)
    assert e("The answer is: Paris. It is big.\nmore") == "Paris"
    assert e("1983. Foinavon won") == "1983" and e("Answer:  x") == "x" and e("Sept. 5") == "Sept" and e("U.S") == "U.S"


def test_em_and_f1(spark):
    assert one(spark, T.em("p", "g"), p="Answer: the Cat.", g="cat") == 1
    assert one(spark, T.token_f1("p", "g"), p="a cat sat", g="cat sat sat") == 0.8
    assert one(spark, T.token_f1("p", "g"), p="", g="the") == 1.0 and one(spark, T.token_f1("p", "g"), p="x", g="") == 0.0


def test_whole_count(spark):
    c = lambda t, v, strict=False: one(spark, T.whole_count("t", "v", strict), t=t, v=v)
    assert c("2006 had 2 events", "2") == 1 and c("Paris and Parisian", "Paris") == 1 and c("2 2", "2") == 2
    assert c("2.3 and 3", "3") == 2 and c("2.3 and 3", "3", True) == 1 and c("1,000 000", "000", True) == 1
    assert c(r"a\E(b a\E(b", r"a\E(b") == 2 and c("x", "") == 0


def test_scopes(spark):
    al = F.array(F.lit("100,000"), F.lit("Paris"))
    assert one(spark, T.contain_any(F.col("r"), al), r="it is paris!") == 1 and one(spark, T.contain_any(F.col("r"), al), r="about 100,000") == 0
    assert one(spark, T.value_any(F.col("r"), al), r="about 100,000") == 1 and one(spark, T.first_integer(F.col("r")), r="none") == ""


def test_types_and_classes(spark):
    t = lambda s: one(spark, T.answer_type("s"), s=s)
    assert [t(x) for x in ("1815", "3-4", "12.5", "Paris", "3000")] == ["date", "date", "numeric", "name", "numeric"]
    c = lambda r: one(spark, T.categorize(F.col("r"), F.array(F.lit("new")), F.array(F.lit("old"))), r=r)
    assert [c(x) for x in ("", "the new one", "old", "I don't know", "zzz")] == ["empty", "new", "old", "refusal", "other"]
    assert one(spark, T.classify_output(F.col("r"), F.array(F.lit("new")), F.array(F.lit("old"))), r="old") == "old"


def test_sentences(spark):
    s = lambda x: one(spark, T.sentences("s"), s=x)
    assert s("He is a U.S. citizen. She left.") == ["He is a U.S. citizen.", "She left."]
    assert s('He said "no." Then left! 好。 x') == ['He said "no.', "Then left!", "好。", "x"] and s("  ") == []


def test_bins_and_years(spark):
    m = lambda v: one(spark, N.magnitude_bin(F.col("v")), v=v)
    assert [m(x) for x in ("0", "7", "1,234", "-12", "0.5", "x")] == [0, 1, 4, 2, 1, -1]
    assert one(spark, N.era(F.col("v")), v="1999") == 99 and one(spark, N.year(F.col("v")), v="2500") is None


def test_verdicts(spark):
    v = lambda x, d, go, ab, ok=True: one(spark, N.verdict(F.col("x"), go, ab, d, F.lit(ok)), x=x)
    assert [v(x, "lower", 0.02, 0.35) for x in (0.01, 0.25, 0.90)] == ["GO", "REVISE", "ABANDON"]
    assert [v(x, "higher", 0.9, 0.55) for x in (0.95, 0.10)] == ["GO", "ABANDON"] and v(0.01, "lower", 0.02, 0.35, False) == "INSUFFICIENT"
    assert [one(spark, N.sequential(F.col("e"), F.col("n")), e=e, n=n) for e, n in ((0.01, 10), (0.01, 60), (0.3, 60), (0.1, 60))] == ["CONTINUE", "GO", "ABANDON", "CONTINUE"]


def test_exact_binomial(spark):
    from math import comb

    for k, n in ((0, 0), (0, 5), (3, 9), (100, 348), (490, 1000), (5000, 10000)):
        want = min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert abs(one(spark, N.binomial_two_sided(F.col("k"), F.col("n")), k=k, n=n) - want) <= 1e-9 * max(want, 1e-30) + 1e-12


def test_hash_mod(spark):
    import hashlib

    for s, n in (("q1|old", 7), ("", 3), ("é", 1_000_003)):
        assert one(spark, N.hash_mod(F.col("s"), F.col("n")), s=s, n=n) == int(hashlib.sha256(s.encode()).hexdigest(), 16) % n


def test_interval_and_sizes(spark):
    lo, hi = N.wilson(F.col("k"), F.col("n"))
    assert one(spark, F.struct(lo, hi), k=0, n=0)[0] is None
    assert round(one(spark, lo, k=1, n=4), 6) == 0.045586 and abs(N.z_sum(0.975, 1.0) - 1.959964) < 1e-3
    assert one(spark, N.n_required(F.col("v"), 0.02), v=2.5 / 9) == 5451 and one(spark, N.n_required(F.col("v"), 0.03), v=2.5 / 9) == 2423
    assert one(spark, N.n_required(F.col("v"), 0.02), v=0.0) == 0 and one(spark, N.within(F.lit(-0.02), F.lit(0.04), 0.05))


def test_question_kinds(spark):
    k = lambda q: one(spark, P.question_kind(F.col("q")), q=q)
    assert [k(x) for x in ("How many moons", "In which year", "When did", "Who is", "Which city", "Which album", "Which navy", "Name it")] == ["count", "year", "time", "person", "place", "work", "org", "other"]
    same = lambda a, b: one(spark, P.same_value(F.col("a"), F.col("b")), a=a, b=b)
    assert same("St. Louis", "st louis") and same("Keatsian", "Keats") and not same("ab", "abc") and not same("", "x")


def test_categories_are_of_the_whole_output(spark):
    """Worked by hand: aliases anywhere in the output, refusals in its first sentence, only an empty output is empty."""
    c = lambda r: one(spark, T.categorize(F.col("r"), F.array(F.lit("42"), F.lit("")), F.array(F.lit("41"))), r=r)
    said = {"Sure. It is 42.": "new", "It was 41. Later 42.": "new", "It was 41. Later 420.": "old", "Answer:": "other", "": "empty", "Unknown. Sorry.": "refusal", "Well. Unknown.": "other", " ": "other"}
    assert {r: c(r) for r in said} == said


def test_recalls_are_of_normalised_tokens(spark):
    r = lambda f, q, p: one(spark, f(T.answer_tokens("q"), T.answer_tokens("p")), q=q, p=p)
    assert r(T.unigram_recall, "Don't stop the music", "dont stop music") == 1.0
    assert r(T.unigram_recall, "a b b c", "b") == 2 / 3 and r(T.unigram_recall, "the", "x") == 0.0
    assert r(T.bigram_recall, "x y x y z", "x y, the y z") == 2 / 3 and r(T.bigram_recall, "x", "x") == 0.0


def test_prompts_word_by_word(spark):
    p = lambda c, chat: one(spark, T.prompt(F.lit("Who?"), F.col("c"), chat), c=c)
    assert p("It was he.", False) == "Read the following context and answer the question with the shortest possible answer. Strictly follow the context; if the context says a value, use that exact value.\nContext: It was he.\n\nQ: Who?\nA: The answer is"
    assert p("", True) == "Answer the question with the shortest possible answer.\nQ: Who?\nA:"
    assert p(None, T.is_instruct(F.lit("m-Instruct"))).endswith("A:") and p(None, T.is_instruct(F.lit("Instruct-m"))).endswith("is")
