"""Named queries of the contamination audit over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import numeric as N
from ..operators import fourarm as A
from ..operators import gates as V
from ..operators import retrieval as R
from ..operators import stats as B
from .fixture import FOURARM, MODELS, fourarm, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_G = "(b - a)", "(d - c)"
_SUM = """count(*) AS n, round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b, round(avg(c), 9) AS mean_c, round(avg(d), 9) AS mean_d,
  round(avg(b - a), 9) AS apparent_gain, round(avg(d - c), 9) AS corrected_gain, round(avg((b - a) - (d - c)), 9) AS did, round(avg((d - c) - (b - a)), 9) AS masking,
  count(*) FILTER (WHERE passed_gates) AS n_pp, round(avg((b - a) - (d - c)) FILTER (WHERE passed_gates), 9) AS did_pp, round(avg((d - c) - (b - a)) FILTER (WHERE passed_gates), 9) AS masking_pp"""


@query(f"WITH {FOURARM} SELECT model, k, {_SUM} FROM fourarm GROUP BY model, k")
def four_arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.summary(fourarm(spark, sf_dir), "model", "k")


@query(f"WITH {FOURARM} SELECT coalesce(kind, CASE WHEN grouping(kind) = 1 THEN 'ALL' END) AS stratum, count(*) AS n, round(avg((d - c) - (b - a)), 9) AS masking FROM fourarm GROUP BY GROUPING SETS ((), (kind))")
def type_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grouping_summary(fourarm(spark, sf_dir), "kind")


_Z2 = N.z_sum() ** 2


@query(
    f"""WITH {FOURARM}, v AS (SELECT model, count(*) AS n, coalesce(var_samp((b - a) - (d - c)), 0) AS v FROM fourarm WHERE k = 5 GROUP BY model)
SELECT model, n, round(v, 9) AS did_variance, CASE WHEN v <= 0 THEN 0 ELSE ceil(v * {_Z2 / 0.02**2!r}::DOUBLE) END::BIGINT AS n_2pp, CASE WHEN v <= 0 THEN 0 ELSE ceil(v * {_Z2 / 0.03**2!r}::DOUBLE) END::BIGINT AS n_3pp FROM v"""
)
def power_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.power_table(fourarm(spark, sf_dir).where("k = 5"), "model")


_SUBSETS = """flags AS (SELECT question_id, model, bool_and(passed_gates) AS s, bool_and(b + d > 0) AS t, bool_and(d = 1) AS y FROM fourarm GROUP BY question_id, model),
sub AS (SELECT question_id, model, 'all' AS subset FROM flags UNION ALL SELECT question_id, model, 'structural' FROM flags WHERE s
  UNION ALL SELECT question_id, model, 'term_present' FROM flags WHERE s AND t UNION ALL SELECT question_id, model, 'compliant' FROM flags WHERE s AND t AND y)"""


@query(f"WITH {FOURARM}, {_SUBSETS} SELECT model, k, subset, {_SUM} FROM fourarm JOIN sub USING (question_id, model) GROUP BY model, k, subset")
def k_axis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.k_report(fourarm(spark, sf_dir))


@query(
    f"""WITH {FOURARM}, w AS (SELECT question_id, model, max(CASE WHEN k = 1 THEN b END) AS b1, max(CASE WHEN k = 5 THEN b END) AS b5, max(CASE WHEN k = 1 THEN d END) AS d1, max(CASE WHEN k = 5 THEN d END) AS d5 FROM fourarm GROUP BY 1, 2)
SELECT model, b1 || '>' || b5 AS b_state, d1 || '>' || d5 AS d_state, count(*) AS n FROM w GROUP BY 1, 2, 3"""
)
def depth_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.transitions(fourarm(spark, sf_dir), 1, 5)


@query(
    f"""WITH {FOURARM}, c AS (SELECT model, k, round(avg(d - c), 9) AS gain FROM fourarm GROUP BY model, k), s AS (SELECT *, gain - lag(gain) OVER (PARTITION BY model ORDER BY k) AS step FROM c)
SELECT model, CASE WHEN coalesce(bool_and(step >= 0), true) THEN 'non-decreasing' WHEN bool_and(step <= 0) THEN 'non-increasing' ELSE 'mixed' END AS shape, first(k ORDER BY gain, k) AS trough_k, count(*) AS n_depths FROM s GROUP BY model"""
)
def monotone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.monotone(fourarm(spark, sf_dir).groupBy("model", "k").agg(F.round(F.avg(A.corrected()), 9).alias("gain")))


@query(
    f"""WITH {FOURARM}, c AS (SELECT model || '/' || k AS config, round(avg(b - a), 9) AS ap, round(avg(d - c), 9) AS co FROM fourarm GROUP BY 1)
SELECT config, row_number() OVER (ORDER BY ap DESC, config) AS apparent_rank, row_number() OVER (ORDER BY co DESC, config) AS corrected_rank, row_number() OVER (ORDER BY ap DESC, config) - row_number() OVER (ORDER BY co DESC, config) AS moved FROM c"""
)
def rank_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fourarm(spark, sf_dir).groupBy(F.concat_ws("/", "model", F.col("k").cast("string")).alias("config")).agg(F.round(F.avg(A.apparent()), 9).alias("apparent"), F.round(F.avg(A.corrected()), 9).alias("corrected"))
    return A.rank_change(cells)


@query(
    f"""WITH {FOURARM}, s AS (SELECT *, sum(a) OVER (PARTITION BY question_id) - a AS strength FROM fourarm WHERE k = 5)
SELECT model, strength::INT AS strength, count(*) AS n, round(avg(b - d), 9) AS cost FROM s GROUP BY 1, 2"""
)
def strength_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.strength_bins(fourarm(spark, sf_dir).where("k = 5"))


@query(f"WITH {FOURARM} SELECT m.model AS dropped, count(*) AS n, round(avg((d - c) - (b - a)), 9) AS mean_without FROM models m JOIN fourarm f ON f.model <> m.model GROUP BY m.model")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.leave_one_out(fourarm(spark, sf_dir), "model", A.masking())


# --- validity gates ---------------------------------------------------------------------------

_CLS = "CASE WHEN d = 1 THEN 'new' WHEN b = 1 AND c = 0 THEN 'old' ELSE 'other' END"


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.when(F.col("d") == 1, "new").when((F.col("b") == 1) & (F.col("c") == 0), "old").otherwise("other")
    return fourarm(spark, sf_dir).where("k = 5").select("*", cls.alias("cls"), (F.col("a") == 1).alias("correct"))


_TRANS = f"""tm AS (SELECT model, count(*) FILTER (WHERE a = 1) AS denom, count(*) FILTER (WHERE a = 1 AND cls = 'old') AS n_old, count(*) FILTER (WHERE a = 1 AND cls = 'new') AS n_new, count(*) FILTER (WHERE a = 1 AND cls = 'other') AS n_other
  FROM (SELECT *, {_CLS} AS cls FROM fourarm WHERE k = 5) GROUP BY model),
tw AS (SELECT *, n_old / denom AS p, 1 + 3.8416::DOUBLE / denom AS g, n_old / denom + 1.9208::DOUBLE / denom AS mid, 1.96::DOUBLE * sqrt((n_old / denom) * (1 - n_old / denom) / denom + 0.9604::DOUBLE / (denom::DOUBLE * denom)) AS half FROM tm)"""


@query(f"WITH {FOURARM}, {_TRANS} SELECT model, denom, n_old, n_new, n_other, round(p, 9) AS residual_old, round(greatest(0, (mid - half) / g), 9) AS ci_low, round(least(1, (mid + half) / g), 9) AS ci_high, round(n_new / denom, 9) AS p_new, round(n_other / denom, 9) AS p_other FROM tw")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.transition_matrix(_classed(spark, sf_dir), "model")


@query(
    f"""WITH {FOURARM}, {_TRANS}, g AS (SELECT *, round(p, 9) AS r, round(least(1, (mid + half) / g), 9) AS hi FROM tw)
SELECT model, 2 AS gate_id, denom AS n, r AS value, CASE WHEN denom >= 30 THEN r <= 0.05 AND hi <= 0.05::DOUBLE + 0.05 END AS passed, CASE WHEN denom >= 30 THEN 'JUDGED' ELSE 'INSUFFICIENT' END AS status,
  CASE WHEN denom < 30 THEN 'INSUFFICIENT' WHEN r <= 0.05 THEN 'GO' WHEN r > 0.15 THEN 'ABANDON' ELSE 'REVISE' END AS verdict,
  CASE WHEN denom >= 30 THEN CASE WHEN denom < 50 THEN 'CONTINUE' WHEN r < 0.05 THEN 'GO' WHEN r > 0.15 THEN 'ABANDON' ELSE 'CONTINUE' END END AS seq FROM g"""
)
def gate2_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gate2(_classed(spark, sf_dir), "model")


@query(
    f"""WITH {FOURARM}, g AS (SELECT model, count(*) AS n, avg(greatest(a, b)) - avg(greatest(c, d)) AS x FROM fourarm WHERE k = 5 GROUP BY model)
SELECT model, 3 AS gate_id, n, round(x, 9) AS value, CASE WHEN n >= 30 THEN abs(x) <= 0.03 END AS passed, CASE WHEN n >= 30 THEN 'JUDGED' ELSE 'INSUFFICIENT' END AS status,
  CASE WHEN n < 30 THEN 'INSUFFICIENT' WHEN abs(x) <= 0.03 THEN 'GO' WHEN abs(x) > 0.10 THEN 'ABANDON' ELSE 'REVISE' END AS verdict FROM g"""
)
def gate3_answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gate3(fourarm(spark, sf_dir).where("k = 5").select("model", F.greatest("a", "b").alias("em_orig"), F.greatest("c", "d").alias("em_sub")), "model")


@query(
    f"""WITH {FOURARM}, g AS (SELECT model, count(*) AS n, avg(({_CLS} = 'new')::INT) AS x FROM fourarm WHERE k = 5 GROUP BY model)
SELECT model, 4 AS gate_id, n, round(x, 9) AS value, CASE WHEN n >= 30 THEN x >= 0.9 END AS passed, CASE WHEN n >= 30 THEN 'JUDGED' ELSE 'INSUFFICIENT' END AS status,
  CASE WHEN n < 30 THEN 'INSUFFICIENT' WHEN x >= 0.9 THEN 'GO' WHEN x < 0.55 THEN 'ABANDON' ELSE 'REVISE' END AS verdict FROM g"""
)
def gate4_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gate4(_classed(spark, sf_dir), "model")


_HITS = "hits AS (SELECT model, question_id, max(b) FILTER (WHERE k <= 5) = 1 AS o, max(d) FILTER (WHERE k <= 5) = 1 AS s FROM fourarm GROUP BY 1, 2)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = F.col("k") <= 5
    return fourarm(spark, sf_dir).groupBy("model", "question_id").agg((F.max(F.when(five, F.col("b"))) == 1).alias("orig_hit"), (F.max(F.when(five, F.col("d"))) == 1).alias("sub_hit"))


@query(
    f"""WITH {FOURARM}, {_HITS}, g AS (SELECT model, count(*) AS n, avg((o AND s)::INT) AS r, avg(o::INT) - avg(s::INT) AS x FROM hits GROUP BY model)
SELECT model, 1 AS gate_id, n, round(r, 9) AS value, CASE WHEN n >= 30 THEN r >= 0.9 AND x <= 0.02 END AS passed, CASE WHEN n >= 30 THEN 'JUDGED' ELSE 'INSUFFICIENT' END AS status,
  CASE WHEN n < 30 THEN 'INSUFFICIENT' WHEN r < 0.9 THEN CASE WHEN r < 0.5 THEN 'ABANDON' ELSE 'REVISE' END WHEN x <= 0.02 THEN 'GO' WHEN x > 0.35 THEN 'ABANDON' ELSE 'REVISE' END AS verdict FROM g"""
)
def gate1_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gate1(_hits(spark, sf_dir), "model")


@query(
    f"""WITH {FOURARM}, {_HITS} SELECT model, count(*) AS n, round(avg(o::INT), 9) AS recall_orig, round(avg(s::INT), 9) AS recall_sub, round(avg((o AND s)::INT), 9) AS joint,
  round(count(*) FILTER (WHERE o AND s) / nullif(count(*) FILTER (WHERE o), 0), 9) AS retention, round((count(*) FILTER (WHERE o) - count(*) FILTER (WHERE s)) / count(*), 9) AS "drop" FROM hits GROUP BY model"""
)
def retrieval_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieval_table(_hits(spark, sf_dir), "model")


@query(
    """WITH p AS (SELECT l.quality AS x, l.toxic AS y FROM labels l), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE x = y) AS ag FROM p), v AS (SELECT x AS v FROM p UNION SELECT y FROM p),
c AS (SELECT sum((SELECT count(*) FROM p WHERE x = v)::DOUBLE * (SELECT count(*) FROM p WHERE y = v)) AS pp FROM v)
SELECT n, n - ag AS conflicts, round((ag / n - pp / (n::DOUBLE * n)) / (1 - pp / (n::DOUBLE * n)), 9) AS kappa, (ag / n - pp / (n::DOUBLE * n)) / (1 - pp / (n::DOUBLE * n)) >= 0.8 AS passed FROM n, c"""
)
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.kappa(table(spark, sf_dir, "labels").select(F.col("quality").alias("x"), F.col("toxic").alias("y")))


# --- statistics --------------------------------------------------------------------------------

_REPS = 40
#: Replicates of the queries that report an interval.
_ALL = SETTINGS.bootstrap_b


def _boot_sql(tag: str, where: str, reps: int = _REPS) -> str:
    return f"""cells AS (SELECT model, ord, a, b, c, d, count(*) AS n FROM fourarm WHERE {where} GROUP BY ALL),
rng AS (SELECT model, ord, a, b, c, d, sum(n) OVER (PARTITION BY model ORDER BY a, b, c, d) AS hi, sum(n) OVER (PARTITION BY model ORDER BY a, b, c, d) - n AS lo FROM cells),
tot AS (SELECT model, ord, sum(n)::BIGINT AS n FROM cells GROUP BY model, ord),
draw AS (SELECT model, r, ('0x' || substr(md5('{tag}|' || model || '|' || r || '|' || j), 1, 8))::BIGINT % n AS i FROM (SELECT model, n, r, unnest(range(1, n + 1)) AS j FROM tot, (SELECT unnest(range(0, {reps})) AS r))),
rep AS (SELECT draw.model, any_value(ord) AS ord, r, avg(b - a) AS apparent, avg(d - c) AS corrected, avg((b - a) - (d - c)) AS did FROM draw JOIN rng ON draw.model = rng.model AND i >= lo AND i < hi GROUP BY draw.model, r)"""


def _replicates(spark: SparkSession, sf_dir: str, tag: str = "boot", reps: int = _REPS) -> DataFrame:
    rows = fourarm(spark, sf_dir, depths=(5,))
    gains = {"ord": F.col("ord"), "apparent": A.apparent(), "corrected": A.corrected(), "did": A.did()}
    orders = F.create_map(*[F.lit(x) for m in MODELS for x in m[:2]])
    reps = B.replicate_means(rows, ["model"], ["a", "b", "c", "d"], {k: v for k, v in gains.items() if k != "ord"}, reps, tag)
    return reps.withColumn("ord", orders[F.col("model")])


@query(
    f"""WITH {FOURARM}, {_boot_sql('boot', 'k = 5', _ALL)}, s AS (SELECT model, list_sort(list(did)) AS v FROM rep GROUP BY model)
SELECT model, round(v[floor(0.025 * {_ALL})::INT + 1], 9) AS ci_low, round(v[least({_ALL}, floor(0.975 * {_ALL})::INT + 1)], 9) AS ci_high FROM s"""
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.order_ci(_replicates(spark, sf_dir, reps=_ALL), ["model"], "did")


@query(f"WITH {FOURARM}, {_boot_sql('boot', 'k = 5', _ALL)} SELECT model, round(quantile_cont(corrected, 0.025), 9) AS ci_low, round(quantile_cont(corrected, 0.975), 9) AS ci_high FROM rep GROUP BY model")
def bootstrap_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.linear_ci(_replicates(spark, sf_dir, reps=_ALL), ["model"], "corrected")


@query(
    f"""WITH {FOURARM}, {_boot_sql('boot', 'k = 5')}, best AS (SELECT r, first(model ORDER BY apparent DESC, ord) AS app, first(model ORDER BY corrected DESC, ord) AS cor FROM rep GROUP BY r)
SELECT 'all' AS space, count(*) AS replicates, round(avg((app <> cor)::INT), 9) AS p_flip FROM best"""
)
def decision_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.flip_probability(_replicates(spark, sf_dir).withColumn("space", F.lit("all")), ["space"], "model", F.col("ord"))


@query()
def bootstrap_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B = 10,000 resamples from pattern counts alone; its law is that of paired_bootstrap."""
    gains = {"did": lambda x: (x["b"] - x["a"]) - (x["d"] - x["c"])}
    reps = B.multinomial_means(fourarm(spark, sf_dir), ["model", "k"], ["a", "b", "c", "d"], gains)
    return B.order_ci(reps, ["model", "k"], "did")


def _full(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SETTINGS.bootstrap_b resamples of the gains; the queries named _full have them, beyond the SQL of their small forms."""
    gains = {"apparent": lambda x: x["b"] - x["a"], "corrected": lambda x: x["d"] - x["c"], "did": lambda x: (x["b"] - x["a"]) - (x["d"] - x["c"])}
    return B.multinomial_means(rows, keys, ["a", "b", "c", "d"], gains)


@query()
def paired_bootstrap_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.order_ci(_full(fourarm(spark, sf_dir, depths=(5,)), ["model"]), ["model"], "did")


@query()
def bootstrap_percentiles_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.linear_ci(_full(fourarm(spark, sf_dir, depths=(5,)), ["model"]), ["model"], "corrected")


@query()
def decision_flip_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = F.create_map(*[F.lit(x) for m in MODELS for x in m[:2]])
    reps = _full(fourarm(spark, sf_dir, depths=(5,)), ["model"]).withColumns({"space": F.lit("all"), "ord": orders[F.col("model")]})
    return B.flip_probability(reps, ["space"], "model", F.col("ord"))


def _binomial_sql(k: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma({n} + 1.0) - lgamma(i + 1.0) - lgamma({n} - i + 1.0) - {n} * ln(2.0))))) END"


def _sign_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fourarm(spark, sf_dir).select("model", F.concat_ws("/", "model", F.col("k").cast("string")).alias("config"), "k", F.col("b").alias("x"), F.col("d").alias("y"))


@query(
    f"""WITH {FOURARM}, t AS (SELECT model, k, count(*) FILTER (WHERE b < d) AS up, count(*) FILTER (WHERE b > d) AS down FROM fourarm GROUP BY model, k)
SELECT model, k, up, down, round({_binomial_sql('least(up, down)', '(up + down)')}, 7) AS p FROM t"""
)
def exact_sign_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.exact_tests(_sign_pairs(spark, sf_dir), "model", "k").withColumn("p", F.round("p", 7))


@query(
    f"""WITH {FOURARM}, t AS (SELECT kind, model || '/' || k AS config, round(avg(passed_gates::INT * ((b - a) - (d - c)) % 7 + 0.5) % 0.05, 9) AS p FROM fourarm WHERE kind IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY kind) AS m, row_number() OVER (PARTITION BY kind ORDER BY p, config) AS rk FROM t)
SELECT kind, config, round(p, 12) AS p, round(least(1, max((m - rk + 1) * p) OVER (PARTITION BY kind ORDER BY p, config ROWS UNBOUNDED PRECEDING)), 12) AS p_holm,
  round(least(1, min(p * m / rk) OVER (PARTITION BY kind ORDER BY p DESC, config DESC ROWS UNBOUNDED PRECEDING)), 12) AS p_bh FROM r"""
)
def multiple_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.round(F.avg(F.col("passed_gates").cast("int") * A.did() % 7 + 0.5) % 0.05, 9)
    tests = fourarm(spark, sf_dir).where(F.col("kind").isNotNull()).groupBy("kind", F.concat_ws("/", "model", F.col("k").cast("string")).alias("config")).agg(p.alias("p"))
    return B.adjusted(tests, "kind", order="config")


@query(
    """SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2,
  round(covar_samp(l_quantity, l_extendedprice) / (stddev_samp(l_quantity) * stddev_samp(l_extendedprice)), 9) AS r FROM lineitem GROUP BY l_returnflag"""
)
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"),
        F.round(F.regr_r2("l_extendedprice", "l_quantity"), 9).alias("r2"),
        F.round(B.pearson(F.col("l_quantity"), F.col("l_extendedprice")), 9).alias("r"),
    )


@query(
    """WITH c AS (SELECT l_linestatus, count(*) AS n, covar_samp(l_quantity, l_quantity) AS s11, covar_samp(l_discount, l_discount) AS s22, covar_samp(l_quantity, l_discount) AS s12,
  covar_samp(l_quantity, l_extendedprice) AS s1y, covar_samp(l_discount, l_extendedprice) AS s2y, covar_samp(l_extendedprice, l_extendedprice) AS syy FROM lineitem GROUP BY l_linestatus),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM c)
SELECT l_linestatus, n, round(b1, 4) AS beta1, round(b2, 3) AS beta2, round((b1 * s1y + b2 * s2y) / syy, 8) AS r2 FROM b"""
)
def two_predictor_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.two_predictors(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_discount", "l_linestatus")
    return out.withColumns({"beta1": F.round("beta1", 4), "beta2": F.round("beta2", 3), "r2": F.round("r2", 8)})


@query(
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT CASE WHEN l_extendedprice < q1 THEN 1 WHEN l_extendedprice < q2 THEN 2 WHEN l_extendedprice < q3 THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(l_discount), 9) AS mean_y FROM lineitem, q GROUP BY 1"""
)
def quartile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.quartile_bins(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_discount")


@query(
    """WITH r AS (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderpriority, o_orderdate) - 1) / 2.0 AS ry FROM orders)
SELECT o_orderpriority, count(*) AS n, round(covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)), 8) AS rho FROM r GROUP BY 1"""
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", B.average_rank("o_totalprice", "o_orderpriority").alias("rx"), B.average_rank("o_orderdate", "o_orderpriority").alias("ry"))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(B.pearson(F.col("rx"), F.col("ry")), 8).alias("rho"))


@query("SELECT c_mktsegment, c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS centred FROM customer")
def within_group_centring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.round(B.centred("c_acctbal", "c_mktsegment"), 6).alias("centred"))


@query(
    f"""WITH {FOURARM}, x AS (SELECT question_id, max(a) FILTER (WHERE model = 'm4') = 1 AS p, max(a) FILTER (WHERE model = 'm5') = 1 AS q FROM fourarm GROUP BY 1), n AS (SELECT count(*) FILTER (WHERE p) AS n1, count(*) FILTER (WHERE q) AS n2, count(*) FILTER (WHERE p AND q) AS m FROM x)
SELECT n1, n2, m, round(n1::DOUBLE * n2 / nullif(m, 0), 9) AS lincoln, round((n1 + 1.0::DOUBLE) * (n2 + 1) / (m + 1) - 1, 9) AS chapman FROM n"""
)
def residual_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lambda m: F.max(F.when(F.col("model") == m, F.col("a"))) == 1
    n = fourarm(spark, sf_dir, depths=(1,)).groupBy("question_id").agg(got("m4").alias("p"), got("m5").alias("q")).agg(F.count_if("p").alias("n1"), F.count_if("q").alias("n2"), F.count_if(F.col("p") & F.col("q")).alias("m"))
    lp, chapman = B.capture_recapture(F.col("n1"), F.col("n2"), F.col("m"))
    return n.select("n1", "n2", "m", F.round(lp, 9).alias("lincoln"), F.round(chapman, 9).alias("chapman"))
