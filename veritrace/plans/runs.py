"""Named queries over whole runs: artifacts reconciled as they are read, spaces of cells, and a grid of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arms as X
from ..operators import corpora as C
from ..operators import grid as G
from ..sources import readers as R
from ..sources import runs as U
from ..sources import sinks as K
from ..sources.scratch import folder
from .corpora import _REBUILT, _questions
from .fixture import FOURARM, fourarm, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _artifacts(spark: SparkSession, sf_dir: str, spoiled: bool) -> dict[str, DataFrame]:
    """The four artifacts of a run over all documents, written and read; `spoiled` ones lack, repeat and contradict rows."""
    rows = fourarm(spark, sf_dir, (5,)).where("model = 'm1'")
    number, own = F.col("question_id"), F.col("question_id").cast("string")
    arms = rows.select(own.alias("question_id"), "model", F.lit("k=5").alias("config_key"), "a", "b", "c", "d", "passed_gates")
    oracle = rows.select(own.alias("question_id"), "kind", F.struct("a", "b", "c", "d").alias("arms_em"), number.alias("number")).withColumnRenamed("kind", "dataset")
    subs = rows.select(own.alias("question_id"), F.lit("old").alias("old_key"), F.concat(F.lit("new"), own).alias("new_key"))
    lp = lambda x: F.struct(x.alias("sum_lp"), (x / 2).alias("mean_lp"), x.alias("first_lp"), F.lit(2).alias("n_tok"), F.lit("space").alias("boundary"))
    old = F.when(number % 11 != 0, lp(-(number % 13).cast("double")))
    memory = rows.select(own.alias("question_id"), number.alias("number"), "model", F.col("kind").alias("dataset"), F.struct(old.alias("old"), lp(-(number % 7).cast("double")).alias("new")).alias("lp"), ((number % 7 - number % 13) / 2).alias("margin_mean"))
    if spoiled:
        n = F.col("question_id").cast("long")
        memory = memory.where("number % 9 <> 0")
        arms = arms.unionByName(arms.where(n % 10 == 1))
        oracle = oracle.withColumn("arms_em", F.when(F.col("number") % 8 == 3, F.struct((1 - F.col("arms_em.a")).alias("a"), *[F.col(f"arms_em.{x}").alias(x) for x in "bcd"])).otherwise(F.col("arms_em")))
        subs = subs.withColumn("new_key", F.when(n % 15 == 4, " ").otherwise(F.col("new_key")))
    path = folder(spark, "artifacts")
    K.run_outputs({"arms": arms, "oracle": oracle.drop("number"), "substituted": subs, "memory": memory.drop("number")}, path, "m1")
    return U.read(spark, path, "m1", "oracle", "arms", "substituted", "memory")


@query(f"""WITH {FOURARM}, r AS (SELECT kind AS dataset, (d - c) - (b - a) AS masking, b - d AS cost, -(question_id % 13) / 2.0 AS lp_old, -(question_id % 7) / 2.0 AS lp_new, (question_id % 7 - question_id % 13) / 2.0 AS margin
FROM fourarm WHERE model = 'm1' AND k = 5 AND question_id % 11 <> 0)
SELECT dataset, count(*) AS n, round(avg(masking), 9) AS masking, round(avg(cost), 9) AS cost, round(avg(lp_old), 9) AS lp_old, round(avg(lp_new), 9) AS lp_new, round(avg(margin), 9) AS margin FROM r GROUP BY dataset""")
def reconciled_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle rows, arms, edits and memory of a run, checked against each other as they are joined."""
    rows = U.memory_pairs(U.reconciled(_artifacts(spark, sf_dir, False)))
    mean = lambda c, name: F.round(F.avg(c), 9).alias(name)
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), mean("masking", "masking"), mean("cost", "cost"), mean("lp_old_mean", "lp_old"), mean("lp_new_mean", "lp_new"), mean("margin_mean", "margin"))


@query("""WITH f AS (SELECT array_to_string(list_filter([CASE WHEN doc_id % 10 = 1 THEN 'arms repeats it' END, CASE WHEN doc_id % 9 = 0 THEN 'memory lacks it' END, CASE WHEN doc_id % 8 = 3 THEN 'arms differ from those recorded' END,
  CASE WHEN doc_id % 15 = 4 THEN 'the edit has no new key' END], lambda x: x IS NOT NULL), ', ') AS fault FROM documents) SELECT fault, count(*) AS n FROM f WHERE fault <> '' GROUP BY fault""")
def run_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What disagrees between the artifacts of a spoiled run."""
    return U.gaps(_artifacts(spark, sf_dir, True)).groupBy("fault").agg(F.count("*").alias("n"))


@query(f"WITH {FOURARM} SELECT model || ':' || k AS cell, count(*) AS n, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d, count(*) FILTER (passed_gates) AS n_pp FROM fourarm WHERE model = 'm2' AND k IN (1, 5, 20) GROUP BY 1")
def cell_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared space of runs, written and read, with items and closed-book arms checked over all of it."""
    rows, path = fourarm(spark, sf_dir, (1, 5, 20)).where("model = 'm2'"), folder(spark, "space")
    cells = {}
    for k in (1, 5, 20):
        out = rows.where(F.col("k") == k).select(F.col("question_id").cast("string").alias("question_id"), "model", F.lit(f"k={k}").alias("config_key"), "a", "b", "c", "d", "passed_gates")
        K.run_outputs({"arms": out}, path, f"k{k}")
        cells[f"m2:{k}"] = R.fourarm(spark, f"{path}/run_label=k{k}/arms")
    return U.space(cells).groupBy("cell").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in "abcd"], F.count_if("passed_gates").alias("n_pp"))


#: Per cent of the items that each stub model answers from memory, and the grid.
_MODELS, _DEPTHS, _BUDGETS = {"s1": 20, "s2": 60}, (1, 3, 5), (100, 2000)


def _knows(percent: int):
    return F.conv(F.substring(F.md5(F.concat(F.lit("grid|"), F.col("question_id"))), 1, 8), 16, 10).cast("long") % 100 < percent


@query(f"""WITH {_REBUILT}, cell AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {p})" for m, p in _MODELS.items())}) AS m(model, pct), (VALUES {', '.join(f'({k})' for k in _DEPTHS)}) AS d(k), (VALUES {', '.join(f'({b})' for b in _BUDGETS)}) AS b(budget)),
h AS (SELECT query_id, side, rank, r.doc_id, len(CASE WHEN side = 'sub' THEN ws ELSE wo END) AS n, CASE WHEN side = 'sub' AND r.doc_id = query_id THEN array_to_string(ws, ' ') ELSE text END AS text FROM r JOIN c USING (query_id, doc_id) JOIN tok USING (doc_id) WHERE rank <= 5),
p AS (SELECT *, sum(n) OVER (PARTITION BY query_id, side ORDER BY rank) AS so_far FROM h),
g AS (SELECT query_id, alias, model, pct, k, budget FROM q, cell),
x AS (SELECT model, pct, k, budget, g.query_id, alias, count(*) FILTER (side = 'orig') AS n_o, count(*) FILTER (side = 'sub') AS n_s, coalesce(bool_or(p.doc_id = p.query_id) FILTER (side = 'orig'), false) AS g_o, coalesce(bool_or(p.doc_id = p.query_id) FILTER (side = 'sub'), false) AS g_s,
  coalesce(string_agg(p.text, chr(10) ORDER BY rank) FILTER (side = 'orig'), '') AS c_o, coalesce(string_agg(p.text, chr(10) ORDER BY rank) FILTER (side = 'sub'), '') AS c_s FROM g LEFT JOIN p ON p.query_id = g.query_id AND rank <= k AND so_far <= budget GROUP BY ALL),
y AS (SELECT *, (('0x' || substr(md5('grid|' || query_id), 1, 8))::BIGINT % 100 < pct)::INT AS a, CASE WHEN c_o <> '' THEN contains(c_o, alias)::INT ELSE (('0x' || substr(md5('grid|' || query_id), 1, 8))::BIGINT % 100 < pct)::INT END AS b, (c_s <> '' AND contains(c_s, 'newvalue'))::INT AS d FROM x)
SELECT model, 'k=' || k || ';budget=' || budget AS config_key, count(*) AS n, sum(n_o)::BIGINT AS orig_docs, sum(n_s)::BIGINT AS sub_docs, round(avg(g_o::INT), 9) AS recall_orig, round(avg(g_s::INT), 9) AS recall_sub, round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b, 0.0::DOUBLE AS mean_c, round(avg(d), 9) AS mean_d FROM y GROUP BY model, k, budget""")
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models, depths and budgets over each question's own corpus: one retrieval, a folder for each cell, and the cells' audit rows together."""
    questions, docs = _questions(spark, sf_dir)
    top = C.paired_best(questions, docs, max(_DEPTHS), 8)
    edited = questions.select("query_id", F.col("gold_id").alias("doc_id"), F.lit("sub").alias("side"), "sub_text")
    hits = top.join(docs, "doc_id").join(edited, ["query_id", "doc_id", "side"], "left").withColumn("text", F.coalesce("sub_text", "text"))
    gold = questions.select("query_id", "gold_id")
    ranked = hits.join(gold, "query_id").select(F.col("query_id").cast("string").alias("question_id"), "side", "rank", "text", F.size(T.bm25_tokens("text")).alias("n_words"), (F.col("doc_id") == F.col("gold_id")).alias("is_gold"))
    path = folder(spark, "grid")
    G.prefixed(ranked).write.parquet(f"{path}/ranked")
    asked = questions.select(F.col("query_id").cast("string").alias("question_id"), "question", F.get("aliases", F.lit(0)).alias("old"), F.lit("newvalue").alias("new"), F.col("aliases").alias("old_aliases"), F.lit(True).alias("passed_gates"))
    K.json_lines(asked, f"{path}/questions")
    asked = spark.read.schema(asked.schema).json(f"{path}/questions")
    generator = lambda model: X.stub(_knows(_MODELS[model]))
    G.run(asked, spark.read.parquet(f"{path}/ranked"), generator, list(G.cells(list(_MODELS), list(_DEPTHS), list(_BUDGETS))), f"{path}/cells", [f"{path}/questions"])
    rows = G.held(spark, f"{path}/cells", "audit", G.AUDIT)
    share = lambda c, name: F.round(F.avg(F.col(c).cast("int")), 9).alias(name)
    return rows.groupBy("model", "config_key").agg(
        F.count("*").alias("n"), F.sum("orig_n_docs").alias("orig_docs"), F.sum("sub_n_docs").alias("sub_docs"), share("orig_has_gold", "recall_orig"), share("sub_has_gold", "recall_sub"), *[share(x, f"mean_{x}") for x in "abcd"],
    )
