"""Named queries on spans, proposals and their outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import pool as P
from ..operators import proposer as PR
from .fixture import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PLACES = """anywhere AS (SELECT *, list_filter(range(0, length(text)), lambda i: substr(text, i::INT + 1, length(answer)) = answer) AS every FROM gold),
whole AS (SELECT *, list_filter(every, lambda i: (i = 0 OR NOT regexp_matches(substr(text, i::INT, 1), '[0-9A-Za-z]')) AND NOT regexp_matches(substr(text, (i + length(answer))::INT + 1, 1), '[0-9A-Za-z]')) AS whole FROM anywhere),
hits AS (SELECT * EXCLUDE (every, whole), CASE WHEN len(whole) > 0 THEN whole ELSE every END AS places FROM whole)"""


@query(
    f"""WITH w AS (SELECT item_id, text, list_filter(list_distinct(regexp_extract_all(text, '[0-9A-Za-z]+')), lambda x: length(x) >= 2) AS answers FROM benchmark), gold AS (SELECT item_id, text, unnest(answers) AS answer FROM w), {_PLACES}
SELECT item_id, answer AS value, p::INT AS "start", (p + length(answer))::INT AS "end" FROM (SELECT item_id, answer, unnest(places) AS p FROM hits)"""
)
def literal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every word of each benchmark item."""
    items = table(spark, sf_dir, "benchmark").where(F.col("text").isNotNull())
    words = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9A-Za-z]+)"))), lambda w: F.length(w) >= 2)
    return PR.spans(items.select("item_id", "text", words.alias("answers")), "text", "answers").select("item_id", "value", "start", "end")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts asked for their size, brand and price by one description, which lacks the price; orders asked for the quantity of their first line."""
    part = table(spark, sf_dir, "part").where("p_size IS NOT NULL")
    text = F.concat(F.col("p_name"), F.lit(" has size "), F.col("p_size").cast("string"), F.lit(", brand "), F.col("p_brand"), F.lit("."))
    price = F.concat(F.lit("$"), F.floor("p_retailprice").cast("string"))
    asked = [("s", F.col("p_size").cast("string"), "numeric"), ("b", F.col("p_brand"), "name"), ("r", price, "numeric")]
    cases = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), a.alias("answer"), F.lit(k).alias("kind")) for q, a, k in asked]))
    one = part.select("p_partkey", F.col("p_name").alias("title"), text.alias("text"), cases.alias("c")).select("*", "c.*")
    no_titles = F.array().cast("array<string>")
    qid = F.concat("q", F.col("p_partkey").cast("string"))
    single = one.select(qid.alias("question_id"), F.lit(False).alias("multi"), F.lit(0).alias("ord"), qid.alias("doc_id"), "title", "text", F.array("answer").alias("answers"), "kind", no_titles.alias("support"))
    qid = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    line = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").select(qid.alias("question_id"), "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    line = line.repartition("question_id")  # one shuffle for lines and orders
    line = line.groupBy("question_id", "l_linenumber").agg(F.min("l_quantity").cast("int").cast("string").alias("q"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    title = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))
    order = W.partitionBy("question_id")  # the lines of one order
    line = line.withColumns({"answer": F.min_by("q", "l_linenumber").over(order), "lines": F.collect_list("l_linenumber").over(order)})
    support = F.transform(F.array_sort("lines"), lambda n: F.concat(F.lit("line "), n.cast("string")))
    text = F.concat(F.lit("On "), title, F.lit(": "), F.col("q"), F.lit(" pieces of part "), F.col("p").cast("string"), F.lit(" from supplier "), F.col("s").cast("string"), F.lit("."))
    chain = line.select(
        "question_id", F.lit(True).alias("multi"), F.col("l_linenumber").alias("ord"), F.concat("question_id", F.lit("-"), F.col("l_linenumber").cast("string")).alias("doc_id"),
        title.alias("title"), text.alias("text"), F.array("answer").alias("answers"), F.lit("numeric").alias("kind"), support.alias("support"),
    )
    return single.unionByName(chain)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size IS NOT NULL")
    sizes = part.select(F.col("p_partkey").alias("ord"), F.lit("numeric").alias("kind"), F.col("p_size").cast("string").alias("value"))
    keys = part.select(F.col("p_partkey").alias("ord"), F.lit("numeric").alias("kind"), F.col("p_partkey").cast("string").alias("value"))
    return P.build_pool(sizes.unionByName(keys))


_PROPOSALS = f"""parts AS (SELECT *, p_name || ' has size ' || p_size || ', brand ' || p_brand || '.' AS text FROM part WHERE p_size IS NOT NULL),
line AS (SELECT l_orderkey, l_linenumber, min(l_quantity)::INT::VARCHAR AS q, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
gold AS (SELECT 's' || p_partkey AS question_id, false AS multi, 0 AS ord, 's' || p_partkey AS doc_id, text, p_size::VARCHAR AS answer, 'numeric' AS kind FROM parts
  UNION ALL SELECT 'b' || p_partkey, false, 0, 'b' || p_partkey, text, p_brand, 'name' FROM parts UNION ALL SELECT 'r' || p_partkey, false, 0, 'r' || p_partkey, text, '$' || floor(p_retailprice)::BIGINT, 'numeric' FROM parts
  UNION ALL SELECT 'o' || l_orderkey, true, l_linenumber, 'o' || l_orderkey || '-' || l_linenumber, 'On line ' || l_linenumber || ': ' || q || ' pieces of part ' || p || ' from supplier ' || s || '.', first_value(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 'numeric' FROM line),
{_PLACES}, pool AS (SELECT value, 'numeric:' || length(ltrim(value, '0')) AS bucket, min(ord) AS ord FROM (SELECT p_size::VARCHAR AS value, p_partkey AS ord FROM parts UNION ALL SELECT p_partkey::VARCHAR, p_partkey FROM parts) GROUP BY ALL),
sized AS (SELECT *, len(places) AS n_hits, regexp_extract_all(text, '[0-9A-Za-z]+') AS words FROM hits),
cand AS (SELECT question_id, doc_id, answer, value, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pool.ord, value) - 1 AS i FROM sized JOIN pool ON kind = 'numeric' AND bucket = 'numeric:' || length(ltrim(answer, '0')) WHERE n_hits > 0 AND value <> answer AND NOT list_contains(words, value)),
pick AS (SELECT doc_id, value AS new, list_reduce(list_concat([0::BIGINT], list_transform(range(0, 8), lambda j: ('0x' || substr(sha256(question_id || '|' || answer), j * 8 + 1, 8))::BIGINT)), lambda x, y: (x * (4294967296 % n) + y % n) % n) = i AS picked FROM cand),
ends AS (SELECT question_id, max(ord) FILTER (WHERE n_hits > 0) AS end_ord FROM sized GROUP BY question_id),
rows AS (SELECT s.*, CASE WHEN n_hits = 1 THEN 'hit' WHEN n_hits > 1 THEN 'first' WHEN multi THEN 'skipped' END AS step, new,
  CASE WHEN n_hits = 0 AND NOT multi THEN 'no_hit' WHEN n_hits > 0 AND new IS NULL THEN 'no_value' END AS fault, (NOT multi OR ord = end_ord) AS is_end FROM sized AS s LEFT JOIN (SELECT doc_id, new FROM pick WHERE picked) USING (doc_id) JOIN ends USING (question_id))"""


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.proposals(_gold(spark, sf_dir), _pool(spark, sf_dir))


@query(
    f"""WITH {_PROPOSALS} SELECT doc_id, coalesce(places[1], -1)::INT AS "start", CASE WHEN n_hits > 0 THEN answer END AS old, new, n_hits, step, fault,
  CASE WHEN step <> 'skipped' THEN CASE WHEN is_end THEN 'terminal' ELSE 'bridge_sync' END END AS role FROM rows"""
)
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of all gold passages; a passage without one starts at -1."""
    return _proposals(spark, sf_dir).select("doc_id", F.coalesce("start", F.lit(-1)).alias("start"), "old", "new", F.col("n_hits").cast("long"), "step", "fault", "role")


_OUTCOMES = f"""{_PROPOSALS}, q AS (SELECT question_id, multi, arg_min(fault, ord) FILTER (WHERE fault IS NOT NULL) AS fault, count(*) FILTER (WHERE fault IS NULL AND step <> 'skipped') AS made, count(*) FILTER (WHERE step = 'skipped') AS n_skipped, bool_or(coalesce(step = 'first', false)) AS several FROM rows GROUP BY ALL),
f AS (SELECT *, coalesce(fault, CASE WHEN made = 0 THEN 'no_proposal' END) AS failed FROM q),
outcomes AS (SELECT question_id, multi, CASE WHEN failed IS NOT NULL THEN 'failed' WHEN several THEN 'llm_disambig' ELSE 'auto' END AS status, coalesce(failed, CASE WHEN several THEN 'first_of_several' ELSE '' END) AS reason, CASE WHEN failed IS NULL THEN made ELSE 0 END AS n_proposals, n_skipped FROM f)"""


@query(f"WITH {_OUTCOMES} SELECT * FROM outcomes")
def proposal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.outcomes(_proposals(spark, sf_dir))


@query(f"WITH {_OUTCOMES} SELECT multi, status, reason, count(*) AS n, sum(n_proposals)::BIGINT AS n_proposals FROM outcomes GROUP BY ALL")
def proposal_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.ledger(PR.outcomes(_proposals(spark, sf_dir)), "multi")
