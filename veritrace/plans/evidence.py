"""Named queries on texts, retrieval, contexts, value borrowing and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import injection as I
from ..operators import pool as P
from ..operators import proposer as PR
from ..operators import retrieval as R
from ..operators import substitute as S
from .fixture import TURNS, first_line_sql, norm_sql, table, tokens_sql, turns

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5, length({norm_sql('text')}) AS n_norm FROM documents WHERE text IS NOT NULL")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.normalize_answer("text")
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.md5(n).alias("norm_md5"), F.char_length(n).cast("long").alias("n_norm"))


@query(f"SELECT conv_id, turn, md5({first_line_sql('text')}) AS answer_md5 FROM conversations WHERE text IS NOT NULL")
def extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(F.col("text").isNotNull()).select("conv_id", "turn", F.md5(T.extract_answer("text")).alias("answer_md5"))


@query(
    f"""WITH {TURNS}, x AS (SELECT conv_id, turn, ({norm_sql(first_line_sql('answer'))} = {norm_sql('text')})::INT AS em, list_filter(string_split({norm_sql('answer')}, ' '), lambda w: w <> '') AS p, list_filter(string_split({norm_sql('text')}, ' '), lambda w: w <> '') AS g FROM turns),
pw AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(p) AS w FROM x) GROUP BY ALL), gw AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(g) AS w FROM x) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(pw.c, gw.c)) AS same FROM pw JOIN gw USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, em, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) + len(g) = 0)::INT ELSE coalesce(same, 0) * 2.0 / (len(p) + len(g)) END, 9)::DOUBLE AS f1 FROM x LEFT JOIN s USING (conv_id, turn)"""
)
def em_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", T.em("answer", "text").alias("em"), F.round(T.token_f1("answer", "text"), 9).alias("f1"))


_FIRST = "regexp_extract(text, '([0-9A-Za-z]+)', 1)"


@query(
    f"""WITH w AS (SELECT doc_id, text, {_FIRST} AS v FROM documents WHERE text IS NOT NULL)
SELECT doc_id, v, CASE WHEN v = '' THEN 0 ELSE len(regexp_extract_all(' ' || regexp_replace(text, '([^0-9A-Za-z])', '\\1\\1', 'g') || ' ', '[^0-9A-Za-z]' || v || '[^0-9A-Za-z]')) END::INT AS n FROM w"""
)
def whole_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).withColumn("v", F.regexp_extract("text", "([0-9A-Za-z]+)", 1))
    return d.select("doc_id", "v", T.whole_count("text", "v").alias("n"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(text, '\s+')) AS v FROM conversations WHERE text IS NOT NULL), t AS (SELECT *, trim(v) AS a FROM w)
SELECT conv_id, turn, count(*) FILTER (WHERE kind = 'date') AS n_date, count(*) FILTER (WHERE kind = 'numeric') AS n_numeric, count(*) FILTER (WHERE kind = 'name') AS n_name
FROM (SELECT *, CASE WHEN regexp_matches(a, '^(1[0-9]{3}|20[0-9]{2})$') OR regexp_matches(a, '[0-9]{1,4}[-/][0-9]{1,2}') THEN 'date' WHEN regexp_matches(a, '^[0-9.,]+$') THEN 'numeric' ELSE 'name' END AS kind FROM t) GROUP BY conv_id, turn"""
)
def answer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull()).select("conv_id", "turn", F.explode(F.split("text", r"\s+")).alias("v")).withColumn("kind", T.answer_type("v"))
    return c.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("date", "numeric", "name")])


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS n_long FROM documents WHERE text IS NOT NULL")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", F.size(T.bm25_tokens("text")).cast("long").alias("n_tokens"), F.size(F.array_distinct(T.long_words("text"))).cast("long").alias("n_long"))


_SENT_SQL = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim({x}, e' \n\t\r'), '(?i)(U\.S|U\.K|Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|e\.g|i\.e|a\.m|p\.m)\.(["'')\]]?\s)', '\1' || chr(57344) || '\2', 'g'),
  '([.!?。！？])["'')\]]?\s+', '\1' || chr(57345), 'g'), chr(57345)), lambda p: trim(replace(p, chr(57344), '.'), e' \n\t\r')), lambda p: p <> '')"""


@query(f"WITH s AS (SELECT doc_id, {_SENT_SQL.format(x='text')} AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", T.sentences("text").alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query()
def token256_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of whole sentences of at most 256 tokens."""
    u = I.units(table(spark, sf_dir, "documents").select("doc_id", "text"), "token256")
    return u.select("doc_id", "sent_idx", "tokens", F.md5("unit").alias("unit_md5"))


@query(
    f"""WITH s AS (SELECT doc_id, {_SENT_SQL.format(x='text')} AS s FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(0, len(s))) AS i, unnest(s) AS unit FROM s),
c AS (SELECT *, sum(len(regexp_extract_all(unit, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]'))) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS used FROM u)
SELECT doc_id, count(*) AS n_units, max(used)::BIGINT AS tokens_used FROM c WHERE used <= 1024 GROUP BY doc_id"""
)
def budget_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = I.budget_prefix(I.units(table(spark, sf_dir, "documents").select("doc_id", "text"), "sentence"), 1024, "doc_id", "sent_idx")
    out = I.assemble(kept.withColumn("is_gold", F.lit(True)), "doc_id", "sent_idx")
    return out.select("doc_id", "n_units", "tokens_used")


# --- leakage and retrieval ----------------------------------------------------------------------

_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_BI = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
LEAST_RECALL = 0.8


@query(
    f"""WITH q AS (SELECT item_id, {tokens_sql('text')} AS w FROM benchmark), d AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents), qb AS (SELECT DISTINCT item_id, unnest({_BI}) AS g FROM q), n AS (SELECT item_id, count(*) AS n FROM qb GROUP BY 1),
db AS (SELECT DISTINCT doc_id, unnest({_BI}) AS g FROM d WHERE len(w) > 1), hit AS (SELECT item_id, doc_id, count(*) AS h FROM qb JOIN db USING (g) GROUP BY ALL)
SELECT item_id, doc_id, round(h / n, 9) AS bigram_recall FROM hit JOIN n USING (item_id) WHERE h >= {LEAST_RECALL} * n"""
)
def leak_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 % of an item's distinct bigrams.

    A document that does must have one of the item's n - ceil(0.8 n) + 1 rarest bigrams, so
    only those are joined; the rest of the item's bigrams are counted for these candidates."""
    # bigrams as 64-bit hashes; the tokens are bound to a variable so that they are made once
    pairs = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.xxhash64(F.get(t, i), F.get(t, i + 1)))
    bi = lambda c: F.array_distinct(F.element_at(F.transform(F.array(T.answer_tokens(c)), pairs), 1))
    two = F.size(T.answer_tokens("text")) >= 2
    items = table(spark, sf_dir, "benchmark").where(two).select("item_id", bi("text").alias("g"))
    gram = items.select("item_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    docs = table(spark, sf_dir, "documents").where(two).select("doc_id", bi("text").alias("g"))
    posts = R.only_known(docs.select("doc_id", F.explode("g").alias("gram")), gram, "gram").persist()
    df = posts.groupBy("gram").agg(F.count("*").alias("df"))
    w = W.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "gram")
    prefix = gram.join(df, "gram", "left").withColumn("i", F.row_number().over(w)).where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * LEAST_RECALL) + 1)
    candidate = prefix.join(posts, "gram").select("item_id", "doc_id").distinct()
    hit = candidate.join(gram, "item_id").join(posts, ["doc_id", "gram"]).groupBy("item_id", "doc_id").agg(F.count("*").alias("h"), F.first("n").alias("n"))
    return hit.where(F.col("h") >= LEAST_RECALL * F.col("n")).select("item_id", "doc_id", F.round(F.col("h") / F.col("n"), 9).alias("bigram_recall"))


_BM25 = f"""q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
dl AS (SELECT doc_id, len({_TOK}) AS dl FROM documents WHERE text IS NOT NULL), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL)"""


@query(
    f"""WITH {_BM25}, st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5"""
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    terms = R.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    posts = R.postings(docs, "doc_id", "text", terms).persist()  # read for document frequencies and for scores
    scores = R.bm25_scores(terms, posts, R.corpus_stats(docs))
    top = R.top_k(scores.withColumn("score", F.round("score", 9)), 5)
    return top.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_BM25}, x AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON (b.item_id + d.doc_id) % 10 = 3 AND d.text IS NOT NULL),
st AS (SELECT query_id, count(*) AS n, avg(dl) AS a FROM (SELECT DISTINCT query_id FROM q) JOIN dl ON true WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = q.query_id AND x.doc_id = dl.doc_id) GROUP BY 1),
p AS (SELECT q.query_id, q.term, qtf, doc_id, tf FROM q JOIN tf USING (term) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = q.query_id AND x.doc_id = tf.doc_id)),
df AS (SELECT query_id, term, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75 * dl / a))) AS score FROM p JOIN df USING (query_id, term) JOIN dl USING (doc_id) JOIN st USING (query_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 5) AS score FROM r WHERE rank <= 5""".replace("FROM (SELECT DISTINCT query_id FROM q) JOIN dl ON true", "FROM (SELECT DISTINCT query_id FROM q) q JOIN dl ON true")
)
def bm25_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item searches the corpus without its own excluded documents, with that corpus's exact statistics."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    items = table(spark, sf_dir, "benchmark")
    terms = R.query_terms(items, "item_id", "text")
    # a stand-in for alias exclusion: residue classes, joined by equality
    excluded = items.select(F.col("item_id").alias("query_id"), F.pmod(3 - F.col("item_id"), F.lit(10)).alias("m")).join(docs.select("doc_id", F.pmod("doc_id", F.lit(10)).alias("m")), "m").select("query_id", "doc_id")
    corpus = docs.select("doc_id", F.size(T.bm25_tokens("text")).alias("dl"))
    posts = R.postings(docs, "doc_id", "text", terms).persist()
    scores = R.restricted_scores(terms, posts, corpus, excluded, R.corpus_stats(docs))
    top = R.top_k(scores.withColumn("score", F.round("score", 8)), 5)
    return top.select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(q.e::DOUBLE[], embedding::DOUBLE[]), 5) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 5"""
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    found = R.dense_top_k(v, v.where("vec_id % 100 = 0"), 8)
    return R.top_k(found.drop("rank").withColumn("score", F.round("score", 5)), 5).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query(
    """WITH base AS (SELECT event_type AS query_id, event_id AS doc_id, value AS score FROM events WHERE value IS NOT NULL), e AS (SELECT event_type AS query_id, event_id + (event_id % 3) * 10000000 AS doc_id, value / 2 + 1 AS score FROM events WHERE event_id % 5 = 0 AND value IS NOT NULL),
m AS (SELECT query_id, doc_id, coalesce(e.score, base.score) AS score FROM base FULL JOIN e USING (query_id, doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m)
SELECT query_id, doc_id, rank, round(score, 9) AS score FROM r WHERE rank <= 20"""
)
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    base = ev.select(F.col("event_type").alias("query_id"), F.col("event_id").alias("doc_id"), F.col("value").alias("score"))
    edited = ev.where("event_id % 5 = 0").select(F.col("event_type").alias("query_id"), (F.col("event_id") + (F.col("event_id") % 3) * 10000000).alias("doc_id"), (F.col("value") / 2 + 1).alias("score"))
    return R.overlay(base, edited, 20).select("query_id", "doc_id", "rank", F.round("score", 9).alias("score"))


# --- value pool, borrowing and edits --------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of orders as dates, part sizes as numbers."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("string").alias("value"), F.lit("date").alias("kind"), F.col("o_orderkey").alias("ord"))
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("value"), F.lit("numeric").alias("kind"), F.col("p_partkey").alias("ord"))
    return o.unionByName(p)


_ANSWERS = "answers AS (SELECT year(o_orderdate)::VARCHAR AS value, 'date' AS kind, o_orderkey AS ord FROM orders UNION ALL SELECT p_size::VARCHAR, 'numeric', p_partkey FROM part)"
_POOL = f"{_ANSWERS}, pool AS (SELECT CASE WHEN kind = 'date' THEN 'date:year' ELSE 'numeric:' || length(value) END AS bucket, value, min(ord) AS ord FROM answers WHERE trim(value) <> '' GROUP BY ALL)"


@query(f"WITH {_POOL} SELECT * FROM pool")
def value_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.build_pool(_answers(spark, sf_dir)).select("bucket", "value", "ord")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where(F.col("p_size").isNotNull())
    passage = F.concat(F.col("p_name"), F.lit(" has size "), F.col("p_size").cast("string"), F.lit(", brand "), F.col("p_brand"), F.lit("."))
    return part.select(F.col("p_partkey").alias("question_id"), F.lit("numeric").alias("kind"), F.col("p_size").cast("string").alias("old"), passage.alias("passage"))


def _borrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rank, as pool.borrow picks it from all pairs; a question has one passage."""
    targets = _targets(spark, sf_dir).withColumn("doc_id", F.col("question_id"))
    return PR.borrowed(targets, P.build_pool(_answers(spark, sf_dir))).drop("doc_id")


_BORROW = f"""{_POOL}, tg AS (SELECT p_partkey AS question_id, p_size::VARCHAR AS old, p_name || ' has size ' || p_size || ', brand ' || p_brand || '.' AS passage FROM part WHERE p_size IS NOT NULL),
u AS (SELECT question_id, old, passage, value, ord, bucket FROM tg JOIN pool ON bucket = 'numeric:' || length(old) AND value <> old AND NOT regexp_matches(passage, '(^|[^0-9A-Za-z])' || value || '([^0-9A-Za-z]|$)')),
nu AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS n, row_number() OVER (PARTITION BY question_id ORDER BY ord, value) - 1 AS i FROM u),
h AS (SELECT *, list_reduce(list_concat([0::BIGINT], list_transform(range(0, 8), lambda j: ('0x' || substr(sha256(question_id || '|' || old), j * 8 + 1, 8))::BIGINT)), lambda x, y: (x * (4294967296 % n) + y % n) % n) AS pick FROM nu),
bo AS (SELECT question_id, old, value AS new, bucket, n AS n_candidates, passage FROM h WHERE i = pick)"""


@query(f"WITH {_BORROW} SELECT question_id, old, new, bucket, n_candidates FROM bo")
def borrow_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _borrowed(spark, sf_dir)


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _targets(spark, sf_dir)
    new = _borrowed(spark, sf_dir).select("question_id", "new")
    start = F.instr("passage", " has size ") + 9
    rows = t.join(new, "question_id").withColumn("start", start).withColumn("end", F.col("start") + F.char_length("old"))
    return S.apply_proposals(rows)


_EDIT = f"""{_BORROW}, ed AS (SELECT *, strpos(passage, ' has size ') + 9 AS s FROM bo), ap AS (SELECT *, substr(passage, 1, s) || new || substr(passage, s + length(old) + 1) AS np,
  len(regexp_extract_all(regexp_replace(' ' || passage || ' ', '([^0-9A-Za-z])', '\\1\\1', 'g'), '[^0-9A-Za-z]' || old || '[^0-9A-Za-z]')) AS n_old FROM ed)"""


@query(
    f"""WITH {_EDIT} SELECT question_id, CASE WHEN n_old = 1 THEN np END AS new_passage, n_old = 1 AS valid,
  n_old = 1 AND len(regexp_extract_all(regexp_replace(' ' || np || ' ', '([^0-9A-Za-z])', '\\1\\1', 'g'), '[^0-9A-Za-z]' || new || '[^0-9A-Za-z]')) = 1 AS gate5, n_old = 1 AS gate6 FROM ap"""
)
def substitute_and_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import gates as V

    e = _edited(spark, sf_dir)
    return e.select(
        "question_id", "new_passage", (F.size("errors") == 0).alias("valid"),
        F.coalesce(F.col("new_passage").isNotNull() & V.gate5(F.col("new_passage"), F.col("new")), F.lit(False)).alias("gate5"),
        F.coalesce(V.gate6(F.col("passage"), F.col("new_passage"), F.col("start"), F.col("end"), F.col("new")), F.lit(False)).alias("gate6"),
    )


@query(f"WITH {_EDIT} SELECT 'unique' AS reason, count(*) AS n FROM ap WHERE n_old <> 1 HAVING count(*) > 0")
def failure_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ledger(_edited(spark, sf_dir))


@query(
    """WITH w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS word FROM benchmark), df AS (SELECT word, count(*) AS df FROM w GROUP BY word), cut AS (SELECT greatest(4, floor(0.08 * count(*))) AS cut FROM benchmark),
r AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY df DESC, word) AS i FROM w JOIN df USING (word), cut WHERE df >= 2 AND df <= cut)
SELECT item_id AS question_id, string_agg(word, ',' ORDER BY word) AS signature FROM r WHERE i <= 6 GROUP BY item_id"""
)
def domain_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.signatures(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text"))
    return s.select("question_id", F.array_join("signature", ",").alias("signature"))


@query("SELECT p_partkey, length(floor(p_retailprice)::BIGINT::VARCHAR) AS magnitude, floor(year(date '1992-01-01' + p_size::INT * 300) / 20)::INT AS era FROM part")
def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year(F.date_add(F.to_date(F.lit("1992-01-01")), F.col("p_size").cast("int") * 300)).cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", N.magnitude_bin(F.col("p_retailprice").cast("decimal(20,2)").cast("string")).cast("long").alias("magnitude"), N.era(y).alias("era"))
