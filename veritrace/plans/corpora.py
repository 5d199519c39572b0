"""Named queries over a corpus for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpora as C
from ..operators.postings import Index
from ..sources.scratch import folder
from .evidence import _TOK
from .fixture import norm_sql, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth document asks by its first eight tokens; its answer is the longest of its first forty, and its edit puts another in all its places."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    w = docs.where("doc_id % 100 = 0").select("doc_id", T.bm25_tokens("text").alias("w")).where(F.size("w") > 0)
    answer = F.array_max(F.transform(F.slice("w", 1, 40), lambda x: F.struct(F.length(x).alias("l"), x.alias("w"))))["w"]
    w = w.withColumn("answer", answer)
    edited = F.array_join(F.transform("w", lambda x: F.when(x == F.col("answer"), "newvalue").otherwise(x)), " ")
    asked = w.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice("w", 1, 8), " ").alias("question"), F.array("answer").alias("aliases"), F.col("doc_id").alias("gold_id"), edited.alias("sub_text"))
    path = folder(spark, "questions")  # written: a plan that reads the edit alone would seek the answer anew at each of its tokens
    asked.write.parquet(path)
    return spark.read.schema(asked.schema).parquet(path), docs


# two indexes for each question, each built from its own corpus
_REBUILT = f"""tok AS (SELECT doc_id, text, {_TOK} AS w, {norm_sql('text')} AS nt FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id AS query_id, text AS gold, w[1:8] AS qw, list_max(list_transform(w[1:40], lambda x: {{'l': length(x), 'w': x}})).w AS alias FROM tok WHERE doc_id % 100 = 0 AND len(w) > 0),
c AS (SELECT query_id, doc_id, w AS wo, CASE WHEN doc_id = query_id THEN list_transform(w, lambda x: CASE WHEN x = alias THEN 'newvalue' ELSE x END) ELSE w END AS ws FROM q JOIN tok ON doc_id = query_id OR (text <> gold AND NOT regexp_matches(nt, '(^|[^0-9a-z])' || alias || '([^0-9a-z]|$)'))),
s AS (SELECT query_id, doc_id, 'orig' AS side, wo AS w FROM c UNION ALL SELECT query_id, doc_id, 'sub', ws FROM c), st AS (SELECT query_id, side, count(*) AS n, avg(len(w)) AS a FROM s GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(qw) AS term FROM q) GROUP BY ALL),
tf AS (SELECT query_id, side, doc_id, dl, term, count(*) AS tf FROM (SELECT query_id, side, doc_id, len(w) AS dl, unnest(w) AS term FROM s) SEMI JOIN qt USING (query_id, term) GROUP BY ALL), df AS (SELECT query_id, side, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, side, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75 * dl / a))), 8) AS score FROM tf JOIN df USING (query_id, side, term) JOIN qt USING (query_id, term) JOIN st USING (query_id, side) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY score DESC, doc_id) AS rank FROM sc)"""


@query(f"WITH {_REBUILT} SELECT query_id, side, doc_id, rank, round(score, 5) AS score FROM r WHERE rank <= 5")
def question_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five of each question's own corpus, with its gold text as it was and as edited, from one pass over one index."""
    questions, docs = _questions(spark, sf_dir)
    top = C.paired_best(questions, docs, 5, 8)
    return top.select("query_id", "side", "doc_id", "rank", F.round("score", 5).alias("score"))


@query(f"WITH {_REBUILT}, g AS (SELECT query_id, min(rank) FILTER (WHERE side = 'orig') AS o, min(rank) FILTER (WHERE side = 'sub') AS s FROM r WHERE doc_id = query_id AND rank <= 5 GROUP BY 1) SELECT count(*) AS n, round(avg((o IS NOT NULL)::INT), 9) AS recall_orig, round(avg((s IS NOT NULL)::INT), 9) AS recall_sub, round(avg((o IS NOT NULL AND s IS NOT NULL)::INT), 9) AS joint FROM q LEFT JOIN g USING (query_id)")
def question_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the gold document before and after the edit."""
    questions, docs = _questions(spark, sf_dir)
    ranks = C.paired_gold_ranks(C.paired_best(questions, docs, 5, 8), questions)
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    o, s = F.col("orig_rank").isNotNull(), F.col("sub_rank").isNotNull()
    return ranks.agg(F.count("*").alias("n"), share(o).alias("recall_orig"), share(s).alias("recall_sub"), share(o & s).alias("joint"))


# --- a stored index and its edits

_EDITED = f"""e AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' ' || (SELECT text FROM benchmark WHERE item_id = doc_id // 10 % 40) ELSE text END AS text FROM documents WHERE text IS NOT NULL AND doc_id % 17 <> 5),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL), dl AS (SELECT doc_id, len({_TOK}) AS dl FROM e WHERE text IS NOT NULL), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM e) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75 * dl / a))), 8) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"""


@query(f"WITH {_EDITED} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def edited_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five after a tenth of the documents got a benchmark text appended and others went: the index is edited, not built anew."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark")
    more = items.where("item_id < 40").select(F.col("item_id").alias("own"), F.col("text").alias("more"))
    changed = docs.where("doc_id % 10 = 3").join(more, F.expr("doc_id div 10 % 40 = own"), "left").select("doc_id", F.concat("text", F.lit(" "), "more").alias("text"))
    gone = docs.where("doc_id % 17 = 5").select("doc_id", F.lit(None).cast("string").alias("text"))
    index = Index.built(docs).upserted(changed).upserted(gone)
    top, _ = index.search(items, "item_id", "text", 5, 8)
    return top.select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))
