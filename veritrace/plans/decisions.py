"""Named queries that end in a decision or an audit: advice per model, evidence swaps, span checks, lost items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arms as X
from ..operators import fourarm as A
from ..operators import injection as I
from ..operators import retrieval as R
from ..operators import stats as B
from ..operators import substitute as S
from .audit import _full
from .fixture import FOURARM, TURNS, fourarm, pairs_sql, table, tokens_sql, turns

QUERIES: dict = {}
SQL: dict[str, str] = {}
_REPS = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_REP_SQL = f"""cells AS (SELECT model, k, a, b, c, d, count(*) AS n FROM fourarm WHERE k <= 5 GROUP BY ALL),
rng AS (SELECT *, sum(n) OVER w AS hi, sum(n) OVER w - n AS lo FROM cells WINDOW w AS (PARTITION BY model, k ORDER BY a, b, c, d)), tot AS (SELECT model, k, sum(n)::BIGINT AS n FROM cells GROUP BY model, k),
draw AS (SELECT model, k, r, ('0x' || substr(md5('advice|' || model || '|' || k || '|' || r || '|' || j), 1, 8))::BIGINT % n AS i FROM (SELECT model, k, n, r, unnest(range(1, n + 1)) AS j FROM tot, (SELECT unnest(range(0, {_REPS})) AS r))),
rep AS (SELECT draw.model, draw.k, r, avg(b - a) AS apparent, avg(d - c) AS corrected FROM draw JOIN rng ON draw.model = rng.model AND draw.k = rng.k AND i >= lo AND i < hi GROUP BY draw.model, draw.k, r)"""


@query(
    f"""WITH {FOURARM}, {_REP_SQL}, best AS (SELECT model, r, first(k ORDER BY apparent DESC, k) AS app, first(k ORDER BY corrected DESC, k) AS cor FROM rep GROUP BY model, r), flip AS (SELECT model, round(avg((app <> cor)::INT), 9) AS p_flip FROM best GROUP BY model),
point AS (SELECT model, k, avg(b - a) AS ap, avg(d - c) AS co FROM fourarm WHERE k <= 5 GROUP BY model, k), pick AS (SELECT model, first(k ORDER BY round(ap, 9) DESC, k) AS app, first(k ORDER BY round(co, 9) DESC, k) AS cor FROM point GROUP BY model),
ci AS (SELECT model, k, v[floor(0.025 * {_REPS})::INT + 1] AS lo, v[least({_REPS}, floor(0.975 * {_REPS})::INT + 1)] AS hi FROM (SELECT model, k, list_sort(list(corrected)) AS v FROM rep GROUP BY model, k))
SELECT model, pick.app AS apparent_best, pick.cor AS corrected_best, p_flip, p_flip > 0.8 AND (x.hi < y.lo OR y.hi < x.lo) AS sensitive FROM pick JOIN flip USING (model) JOIN ci x ON x.model = pick.model AND x.k = pick.app JOIN ci y ON y.model = pick.model AND y.k = pick.cor""".replace("FROM pick JOIN flip USING (model)", "FROM pick JOIN flip ON flip.model = pick.model").replace("SELECT model, pick.app", "SELECT pick.model, pick.app")
)
def config_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model: the best depth by apparent and by corrected gain, how often they differ, and whether to change."""
    rows = fourarm(spark, sf_dir, depths=(1, 3, 5))
    reps = B.replicate_means(rows, ["model", "k"], list("abcd"), {"apparent": A.apparent(), "corrected": A.corrected()}, _REPS, "advice").persist()
    return _advice(rows, reps)


@query()
def config_advice_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """config_advice from SETTINGS.bootstrap_b resamples."""
    rows = fourarm(spark, sf_dir, depths=(1, 3, 5))
    return _advice(rows, _full(rows, ["model", "k"]))


def _advice(rows: DataFrame, reps: DataFrame) -> DataFrame:
    flip = B.flip_probability(reps, ["model"], "k", F.col("k")).select("model", "p_flip")
    ci = B.order_ci(reps, ["model", "k"], "corrected")
    point = rows.groupBy("model", "k").agg(F.round(F.avg(A.apparent()), 9).alias("ap"), F.round(F.avg(A.corrected()), 9).alias("co"))
    pick = point.groupBy("model").agg(F.max_by("k", F.struct("ap", -F.col("k"))).alias("apparent_best"), F.max_by("k", F.struct("co", -F.col("k"))).alias("corrected_best"))
    side = lambda k, p: ci.select("model", F.col("k").alias(k), F.col("ci_low").alias(f"{p}lo"), F.col("ci_high").alias(f"{p}hi"))
    out = pick.join(flip, "model").join(side("apparent_best", "x"), ["model", "apparent_best"]).join(side("corrected_best", "y"), ["model", "corrected_best"])
    return out.select("model", "apparent_best", "corrected_best", "p_flip", B.sensitive(F.col("p_flip"), F.col("xlo"), F.col("xhi"), F.col("ylo"), F.col("yhi")).alias("sensitive"))


@query(
    f"""WITH {FOURARM}, s AS (SELECT question_id, model, kind, sum(a) OVER (PARTITION BY question_id) - a AS strength, b - d AS reliance FROM fourarm WHERE k = 10),
x AS (SELECT 'all' AS slice, * FROM s UNION ALL SELECT 'remembered', * FROM s WHERE strength > 0)
SELECT slice, model, count(*) AS n, round(regr_slope(reliance, strength), 8) AS slope, round(regr_r2(reliance, strength), 8) AS r2 FROM x GROUP BY slice, model"""
)
def evidence_swap_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliance on evidence against memory strength, by slice."""
    w = W.partitionBy("question_id")
    s = fourarm(spark, sf_dir, depths=(10,)).select("model", (F.sum("a").over(w) - F.col("a")).alias("strength"), (F.col("b") - F.col("d")).alias("reliance"))
    slices = F.array_compact(F.array(F.lit("all"), F.when(F.col("strength") > 0, F.lit("remembered"))))
    x = s.select("model", "strength", "reliance", F.explode(slices).alias("slice"))
    return x.groupBy("slice", "model").agg(F.count("*").alias("n"), F.round(F.regr_slope("reliance", "strength"), 8).alias("slope"), F.round(F.regr_r2("reliance", "strength"), 8).alias("r2"))


@query(
    """WITH s AS (SELECT event_type, event_id % 50 AS s1, event_id % 50 + 1 + event_id % 7 AS e1, event_id % 47 AS s2, event_id % 47 + 1 + event_id % 5 AS e2 FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE NOT greatest(s1, s2) < least(e1, e2)) AS changed, round(avg(abs(s1 - s2)), 9) AS mean_offset FROM s GROUP BY event_type"""
)
def span_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two finders: how many lie apart, and how far."""
    i = F.col("event_id")
    s = table(spark, sf_dir, "events").select("event_type", (i % 50).alias("s1"), (i % 50 + 1 + i % 7).alias("e1"), (i % 47).alias("s2"), (i % 47 + 1 + i % 5).alias("e2"))
    apart = ~S.overlaps(*[F.col(c) for c in ("s1", "e1", "s2", "e2")])
    return s.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(apart).alias("changed"), F.round(F.avg(F.abs(F.col("s1") - F.col("s2"))), 9).alias("mean_offset"))


@query(
    f"""WITH {FOURARM}, p AS (SELECT question_id, model, bool_and(passed_gates) AS ok, max(d) FILTER (WHERE k = 1) AS d1, max(d) FILTER (WHERE k = 5) AS d5, max(b) FILTER (WHERE k = 5) AS b5, max(c) AS c FROM fourarm GROUP BY 1, 2)
SELECT model, count(*) AS n_lost, count(*) FILTER (WHERE b5 = 1) AS still_reads, count(*) FILTER (WHERE c = 1) AS knows_new FROM p WHERE ok AND d1 = 1 AND d5 = 0 GROUP BY model"""
)
def lost_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that follow the evidence at depth 1 and no longer at depth 5."""
    at = lambda arm, k: F.max(F.when(F.col("k") == k, F.col(arm)))
    p = fourarm(spark, sf_dir).groupBy("question_id", "model").agg(F.bool_and("passed_gates").alias("ok"), at("d", 1).alias("d1"), at("d", 5).alias("d5"), at("b", 5).alias("b5"), F.max("c").alias("c"))
    return p.where("ok AND d1 = 1 AND d5 = 0").groupBy("model").agg(F.count("*").alias("n_lost"), F.count_if(F.col("b5") == 1).alias("still_reads"), F.count_if(F.col("c") == 1).alias("knows_new"))


@query(
    f"""WITH {FOURARM}, g AS (SELECT model, avg((d - c) - (b - a)) FILTER (WHERE kind IN ('en', 'de')) AS x, avg((d - c) - (b - a)) FILTER (WHERE kind IN ('fr', 'es')) AS y FROM fourarm GROUP BY model) SELECT model, round(x, 9) AS first, round(y, 9) AS second, round(x - y, 9) AS difference FROM g"""
)
def stratum_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking of two strata of items and their difference, by model."""
    m = lambda kinds: F.avg(F.when(F.col("kind").isin(*kinds), A.masking()))
    g = fourarm(spark, sf_dir).groupBy("model").agg(m(("en", "de")).alias("x"), m(("fr", "es")).alias("y"))
    return g.select("model", F.round("x", 9).alias("first"), F.round("y", 9).alias("second"), F.round(F.col("x") - F.col("y"), 9).alias("difference"))


@query(
    """WITH g AS (SELECT o_orderkey, list_distinct(list(l_partkey % 20)) AS gold FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey), p AS (SELECT l_orderkey AS o_orderkey, list(l_suppkey % 20) AS have FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(len(list_intersect(have, gold)) / len(gold), 9) AS recall FROM g JOIN p USING (o_orderkey)"""
)
def support_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an order's part classes that its supplier classes cover: support facts in other words."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 20).alias("gold"), F.collect_list(F.col("l_suppkey") % 20).alias("have"))
    return table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.round(I.support_recall(F.col("have"), F.col("gold")), 9).alias("recall"))


@query(
    """WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_orderkey % 7 = 0 AS is_gold, o_orderkey % 3 = 0 AS dirty, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), n AS (SELECT query_id, count(*) FILTER (WHERE is_gold) AS n FROM h GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dirty, rank, doc_id) AS r FROM h WHERE NOT is_gold) SELECT query_id AS question_id, doc_id, rank FROM r JOIN n USING (query_id) WHERE r <= n"""
)
def swap_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many clean non-gold hits as gold ones, best first."""
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    h = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 7 == 0).alias("is_gold"), (F.col("o_orderkey") % 3 == 0).alias("dirty"), rank.alias("rank"))
    return X.swap_contexts(h).select("question_id", "doc_id", "rank")


@query(
    """WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT query_id, coalesce(min(rank) FILTER (WHERE doc_id % 7 = 0), 0)::INT AS gold_rank FROM h WHERE rank <= 5 GROUP BY query_id"""
)
def gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the first gold hit within five, 0 where there is none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))
    found = R.gold_rank(R.top_k(o, 5), o.where("doc_id % 7 = 0").select("query_id", "doc_id"))
    return found.select("query_id", F.coalesce("gold_rank", F.lit(0)).alias("gold_rank"))


@query(
    f"""WITH {TURNS}, t AS (SELECT conv_id, turn, {tokens_sql('text')} AS q, {tokens_sql('answer')} AS p FROM turns), g AS (SELECT *, list_distinct({pairs_sql('q')}) AS qb, {pairs_sql('p')} AS pb FROM t)
SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_filter(q, lambda w: list_contains(p, w))) / len(q) END, 9) AS unigram_recall,
  round(CASE WHEN len(qb) = 0 THEN 0 ELSE len(list_filter(qb, lambda w: list_contains(pb, w))) / len(qb) END, 9) AS bigram_recall FROM g"""
)
def unigram_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a turn's tokens and pairs of tokens that the next turn has."""
    t = turns(spark, sf_dir).select("conv_id", "turn", T.answer_tokens("text").alias("q"), T.answer_tokens("answer").alias("p"))
    return t.select("conv_id", "turn", *[F.round(f(F.col("q"), F.col("p")), 9).alias(f.__name__) for f in (T.unigram_recall, T.bigram_recall)])
