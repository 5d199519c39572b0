"""Named composite queries: stub runs, re-scoring, compliance, windows, annotation and equivalence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import annotate as AN
from ..operators import arms as X
from ..operators import fourarm as A
from ..functions import text as T
from ..operators import gold as G
from ..operators import pool as P
from ..operators import stats as B
from .audit import _ALL, _boot_sql, _full, _replicates
from .evidence import _EDIT, _edited
from .fixture import FOURARM, TURNS, first_line_sql, fourarm, norm_sql, table, turns

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edited(spark, sf_dir).where(F.size("errors") == 0)
    return e.select("question_id", F.lit("What size is it?").alias("question"), "old", "new", F.array("old").alias("old_aliases"), F.col("passage").alias("orig_context"), F.col("new_passage").alias("sub_context"), F.col("passage").alias("gold_orig"), F.col("new_passage").alias("gold_sub"))


_KNOWN = "('0x' || substr(md5('mem|' || question_id), 1, 8))::BIGINT % 1000 < 400"


def _memory():
    return F.conv(F.substring(F.md5(F.concat(F.lit("mem|"), F.col("question_id").cast("string"))), 1, 8), 16, 10).cast("long") % 1000 < 400


@query(f"WITH {_EDIT} SELECT question_id, ({_KNOWN})::INT AS a, 1 AS b, 0 AS c, 1 AS d FROM ap WHERE n_old = 1")
def stub_four_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits, contexts, a stub generator and scoring, end to end."""
    return X.four_arms(_items(spark, sf_dir), X.stub(_memory())).select("question_id", "a", "b", "c", "d")


@query(f"WITH {_EDIT} SELECT question_id, 1 AS em_orig, 1 AS em_sub, 'new' AS cls_sub, true AS term_present FROM ap WHERE n_old = 1")
def stub_oracle_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.oracle_pair(_items(spark, sf_dir), X.stub(_memory())).select("question_id", "em_orig", "em_sub", "cls_sub", "term_present")


@query(f"WITH {_EDIT}, s(scope) AS (VALUES ('v3'), ('contain'), ('val')) SELECT scope, count(*) AS n, round(avg(({_KNOWN})::INT), 9) AS a, 1.0 AS b, 0.0 AS c, 1.0 AS d FROM ap, s WHERE n_old = 1 GROUP BY scope")
def rescored_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    raw = X.four_arms(items, X.stub(_memory())).select("question_id", "arms_raw").join(items.select("question_id", "old_aliases", F.array("new").alias("new_aliases")), "question_id")
    return X.rescored(raw).groupBy("scope").agg(F.count("*").alias("n"), *[F.round(F.avg(k), 9).alias(k) for k in "abcd"])


_REFUSALS = ", ".join("'" + x.replace("'", "''") + "'" for x in T.REFUSALS)
_HOLDS = lambda a: f"({a} <> '' AND regexp_matches(lower(answer), '(^|[^0-9a-z])' || regexp_escape(lower({a})) || '([^0-9a-z]|$)'))"


@query(
    f"""WITH {TURNS}, w AS (SELECT *, string_split(text, ' ') AS w FROM turns), x AS (SELECT role, answer, w[1] AS new, coalesce(w[2], '') AS old, {norm_sql(first_line_sql('answer'))} AS said FROM w),
y AS (SELECT role, said = {norm_sql('new')} AS strict, CASE WHEN answer = '' THEN 'empty' WHEN {_HOLDS('new')} THEN 'new' WHEN {_HOLDS('old')} THEN 'old' WHEN list_aggregate(list_transform([{_REFUSALS}], lambda m: contains(lower({first_line_sql('answer')}), m)), 'bool_or') THEN 'refusal' ELSE 'other' END AS kind FROM x)
SELECT role, count(*) AS n, round(avg(strict::INT), 9) AS strict_new, round(avg((kind = 'new')::INT), 9) AS lenient_new, {', '.join(f"count(*) FILTER (WHERE NOT strict AND kind = '{k}') AS n_{k}" for k in ('empty', 'new', 'old', 'refusal', 'other'))} FROM y GROUP BY role"""
)
def compliance_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as outputs: the first word of the turn before is the new answer, its second the old one."""
    word = lambda k: F.array(F.coalesce(F.get(F.split("text", " "), k), F.lit("")))
    rows = turns(spark, sf_dir).select("role", F.col("answer").alias("raw"), word(0).alias("new_aliases"), word(1).alias("old_aliases"))
    return X.compliance(rows, "role")


@query()
def answer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of documents around a word of a benchmark item, with that item as the question; every item is looked for in every document."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("page"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.slice(F.split(F.lower("text"), "[^a-z]+"), 3, 2).alias("aliases"))
    return G.best_windows(items, docs)


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents), i AS (SELECT unnest(range(0, 90)) AS i)
SELECT doc_id FROM r WHERE n <= 90 OR place IN (SELECT floor(i * n / 90)::BIGINT FROM i, (SELECT count(*) AS n FROM documents))"""
)
def annotation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AN.systematic(table(spark, sf_dir, "documents").select("doc_id"), 90, "doc_id")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY sha256('20260903|' || (l_orderkey * 10 + l_linenumber)), l_orderkey * 10 + l_linenumber) AS i FROM lineitem) SELECT l_orderkey, l_linenumber FROM r WHERE i <= 240")
def seeded_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))
    return AN.subset(rows, 240, "key").select("l_orderkey", "l_linenumber")



@query(
    f"""WITH x AS (SELECT DISTINCT doc_id, quality = 1 AS a, CASE WHEN ('0x' || substr(md5(doc_id || '|w'), 1, 8))::BIGINT % 10 < 9 THEN quality = 1 ELSE quality <> 1 END AS b FROM labels),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS ag, count(*) FILTER (WHERE a) AS pa, count(*) FILTER (WHERE b) AS pb FROM x), k AS (SELECT *, (pa::DOUBLE * pb + (n - pa)::DOUBLE * (n - pb)) / (n::DOUBLE * n) AS pe FROM n)
SELECT 'quality' AS dimension, n, n - ag AS conflicts, round((ag / n - pe) / (1 - pe), 9) AS kappa, (ag / n - pe) / (1 - pe) >= 0.8 AS passed FROM k"""
)
def annotation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"), (F.col("quality") == 1).alias("quality")).distinct()
    flip = F.conv(F.substring(F.md5(F.concat(F.col("task_id").cast("string"), F.lit("|w"))), 1, 8), 16, 10).cast("long") % 10 < 9
    second = first.withColumn("quality", F.when(flip, F.col("quality")).otherwise(~F.col("quality")))
    return AN.agreement(AN.merged(first, second, ("quality",)), ("quality",))


@query(
    f"""WITH {FOURARM}, {_boot_sql('boot', 'k = 5', _ALL)}, s AS (SELECT model, list_sort(list(did)) AS v FROM rep GROUP BY model), c AS (SELECT model, round(v[floor(0.05 * {_ALL})::INT + 1], 9) AS ci_low, round(v[least({_ALL}, floor(0.95 * {_ALL})::INT + 1)], 9) AS ci_high FROM s)
SELECT model, ci_low, ci_high, ci_low > -0.05 AND ci_high < 0.05 AS equivalent_5pp, ci_low > -0.03 AND ci_high < 0.03 AS equivalent_3pp FROM c"""
)
def equivalence_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _equivalence(_replicates(spark, sf_dir, reps=_ALL))


@query()
def equivalence_test_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _equivalence(_full(fourarm(spark, sf_dir, depths=(5,)), ["model"]))


def _equivalence(replicates: DataFrame) -> DataFrame:
    ci = B.order_ci(replicates, ["model"], "did", (0.05, 0.95))
    lo, hi = F.col("ci_low"), F.col("ci_high")
    return ci.select("model", "ci_low", "ci_high", N.within(lo, hi, 0.05).alias("equivalent_5pp"), N.within(lo, hi, 0.03).alias("equivalent_3pp"))


@query(f"WITH {FOURARM}, n AS (SELECT model, k, count(*) AS n, count(DISTINCT question_id) AS ids FROM fourarm GROUP BY model, k) SELECT model, k, n, n = ids AS unique_ids, true AS arms_valid FROM n")
def execution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance of every cell: ids appear once, arms are 0 or 1."""
    rows = fourarm(spark, sf_dir)
    ok = F.lit(True)
    for arm in A.ARMS:
        ok = ok & F.coalesce(F.col(arm).isin(0, 1), F.lit(False))
    once = rows.groupBy("model", "k", "question_id").agg(F.count("*").alias("c"), F.bool_and(ok).alias("ok"))
    return once.groupBy("model", "k").agg(F.sum("c").alias("n"), (F.max("c") == 1).alias("unique_ids"), F.bool_and("ok").alias("arms_valid"))


@query("WITH m(model, params_b, bits, ctx) AS (VALUES ('0.6B', 0.6::DOUBLE, 16, 4096), ('4B', 4.0, 4, 4096), ('8B', 8.0, 4, 4096), ('32B', 32.0, 4, 1024)), t AS (SELECT *, params_b * bits / 8 + ctx * 294912.0::DOUBLE / 2e9 + 1.2 AS g FROM m) SELECT model, params_b, bits, ctx, round(g, 2) AS total_gb, g <= 8 AS fits_8gb FROM t")
def model_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.total_vram(spark.createDataFrame([("0.6B", 0.6, 16, 4096), ("4B", 4.0, 4, 4096), ("8B", 8.0, 4, 4096), ("32B", 32.0, 4, 1024)], "model string, params_b double, bits int, ctx int"))


@query(
    f"""WITH {FOURARM} SELECT model, CASE WHEN a = 1 THEN 'remembered' ELSE 'not remembered' END AS stratum, count(*) AS n, round(avg((d - c) - (b - a)), 9) AS masking FROM fourarm WHERE k = 5 GROUP BY 1, 2"""
)
def conditional_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fourarm(spark, sf_dir, depths=(5,)).withColumn("stratum", F.when(F.col("a") == 1, "remembered").otherwise("not remembered"))
    return rows.groupBy("model", "stratum").agg(F.count("*").alias("n"), F.round(F.avg(A.masking()), 9).alias("masking"))


@query(
    f"""WITH {FOURARM}, s AS (SELECT question_id FROM fourarm WHERE k = 5 AND a = 1 GROUP BY question_id HAVING count(DISTINCT model) = 5) SELECT count(*) AS n_all_models, (SELECT count(DISTINCT question_id) FROM fourarm) AS n_items FROM s"""
)
def common_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that every model answers closed-book."""
    rows = fourarm(spark, sf_dir, depths=(5,))
    per = rows.groupBy("question_id").agg(F.count_distinct(F.when(F.col("a") == 1, F.col("model"))).alias("m"))
    return per.agg(F.count_if(F.col("m") == 5).alias("n_all_models"), F.count("*").alias("n_items"))




@query(
    f"""WITH {FOURARM}, c AS (SELECT model, question_id // 10 AS cl, sum((d - c) - (b - a)) AS s, count(*) AS m FROM fourarm WHERE k = 5 GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY cl) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM c), t AS (SELECT DISTINCT model, n FROM p),
dr AS (SELECT model, r, ('0x' || substr(md5('cluster|' || model || '|' || r || '|' || j), 1, 8))::BIGINT % n AS i FROM (SELECT model, n, r, unnest(range(1, n + 1)) AS j FROM t, (SELECT unnest(range(0, {_ALL})) AS r))),
rep AS (SELECT dr.model, r, sum(s)::DOUBLE / sum(m) AS masking FROM dr JOIN p USING (model, i) GROUP BY dr.model, r)
SELECT model, round(quantile_cont(masking, 0.025), 9) AS ci_low, round(quantile_cont(masking, 0.975), 9) AS ci_high FROM rep GROUP BY model"""
)
def clustered_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fourarm(spark, sf_dir, depths=(5,)).select("model", F.floor(F.col("question_id") / 10).alias("cl"), A.masking().alias("masking"))
    return B.linear_ci(B.cluster_means(rows, ["model"], "cl", "masking", _ALL, "cluster"), ["model"], "masking")


@query()
def clustered_bootstrap_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SETTINGS.bootstrap_b resamples of whole clusters."""
    rows = fourarm(spark, sf_dir, depths=(5,)).select("model", F.floor(F.col("question_id") / 10).alias("cl"), A.masking().alias("masking"))
    return B.linear_ci(B.cluster_multinomial_means(rows, ["model"], "cl", "masking"), ["model"], "masking")


@query(
    """WITH f AS (SELECT DISTINCT item_id, w AS form FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS w FROM benchmark)), n AS (SELECT DISTINCT x.item_id, y.item_id AS other FROM f x JOIN f y USING (form)),
a AS (SELECT DISTINCT n.item_id, f.form FROM n JOIN f ON f.item_id = n.other) SELECT item_id AS question_id, count(*) AS n_forms, md5(string_agg(form, '|' ORDER BY form)) AS forms_md5 FROM a GROUP BY item_id"""
)
def alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of an item stand in for its aliases."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), T.long_words("text", 9).alias("aliases"))
    out = P.alias_closure(rows)
    return out.select("question_id", F.size("forms").cast("long").alias("n_forms"), F.md5(F.array_join("forms", "|")).alias("forms_md5"))


@query(
    """WITH p AS (SELECT DISTINCT p_brand AS subject, p_type AS value FROM part), t AS (SELECT lower(p_name || ' ' || p_brand || ' ' || p_type) AS text FROM part)
SELECT subject, value, (SELECT count(*) FROM t WHERE contains(text, lower(subject)) AND contains(text, lower(value))) AS n FROM p"""
)
def cooccurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return P.cooccurrences(part.select(F.col("p_brand").alias("subject"), F.col("p_type").alias("value")), part.select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text")))


@query()
def name_borrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for benchmark items by topic words, number of words and kind of question."""
    items = table(spark, sf_dir, "benchmark").where(F.col("text").isNotNull()).select(F.col("item_id").alias("question_id"), "text")
    old = F.initcap(F.element_at(T.long_words("text", 5), 1))
    rows = items.join(P.signatures(items), "question_id", "left").select("question_id", "text", old.alias("old"), F.coalesce("signature", F.array().cast("array<string>")).alias("signature"), P.question_kind(F.col("text")).alias("asks")).where("old IS NOT NULL").withColumn("band", T.token_band(F.col("old")))
    pool = rows.groupBy(F.col("old").alias("value")).agg(F.min("question_id").alias("ord"), F.min_by("signature", "question_id").alias("signature"), F.first("band").alias("band"), F.min_by("asks", "question_id").alias("asks"))
    return P.borrow_names(rows.select("question_id", "old", F.array(T.normalize_answer("old")).alias("forms"), "signature", "band", "asks", F.col("text").alias("passage")), pool, typed=True)


@query(
    f"""WITH {FOURARM}, x AS (SELECT model, (b - d)::DOUBLE AS cost, sum(a) OVER (PARTITION BY question_id) - a - avg(a) OVER (PARTITION BY model) AS s, (c - avg(c) OVER (PARTITION BY model)) AS z FROM fourarm WHERE k = 5),
v AS (SELECT model, count(*) AS n, covar_samp(s, s) AS s11, covar_samp(z, z) AS s22, covar_samp(s, z) AS s12, covar_samp(s, cost) AS s1y, covar_samp(z, cost) AS s2y, covar_samp(cost, cost) AS syy FROM x GROUP BY model),
w AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM v)
SELECT model, n, round(b1, 8) AS beta1, round(b2, 8) AS beta2, round((b1 * s1y + b2 * s2y) / syy, 8) AS r2 FROM w"""
)
def memory_strength_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost on centred strength and a second predictor, by model."""
    from pyspark.sql import Window as W

    rows = fourarm(spark, sf_dir, depths=(5,))
    others = F.sum("a").over(W.partitionBy("question_id")) - F.col("a") - F.avg("a").over(W.partitionBy("model"))
    x = rows.select("model", (F.col("b") - F.col("d")).cast("double").alias("cost"), others.alias("s"), B.centred("c", "model").alias("z"))
    return B.two_predictors(x, "cost", "s", "z", "model").select("model", "n", *[F.round(c, 8).alias(c) for c in ("beta1", "beta2", "r2")])


@query(f"WITH {FOURARM}, h AS (SELECT * FROM fourarm WHERE k = 1 OR k = 5) SELECT k, count(*) FILTER (WHERE b = 1 AND d = 0) AS lost, count(*) FILTER (WHERE b = 0 AND d = 1) AS won, round(avg(d), 9) AS mean_d FROM h GROUP BY k")
def directional_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ups and downs behind a mean that may hide them."""
    rows = fourarm(spark, sf_dir, depths=(1, 5))
    return rows.groupBy("k").agg(F.count_if((F.col("b") == 1) & (F.col("d") == 0)).alias("lost"), F.count_if((F.col("b") == 0) & (F.col("d") == 1)).alias("won"), F.round(F.avg("d"), 9).alias("mean_d"))
