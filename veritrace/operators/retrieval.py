"""BM25 over an inverted index, overlay merges, exact dense search and retrieval measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T


#: Rows that a set of keys may have to be broadcast.
BROADCAST_KEYS = 500_000
#: Documents of a partition of postings: its scores, at most one for each query and document, stay in one task's memory.
DOCS_EACH = 8192
#: Scores that a task of a dense search holds at once.
SCORES_AT_ONCE = 1 << 20


def only_known(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose column is among the keys: by a broadcast where the keys are counted to be few, so that rows
    are dropped where they are read, else by a shuffled semi-join."""
    known = keys.select(column).distinct()
    if known.count() <= BROADCAST_KEYS:
        known = F.broadcast(known)
    return rows.join(known, column, "left_semi")


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents and mean length in tokens."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(T.bm25_tokens(text))).alias("avgdl"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """Terms of each query with the times they occur in it."""
    return queries.select(F.col(key).alias("query_id"), F.explode(T.bm25_tokens(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """term, doc_id, tf and document length; with `terms` only for those.

    Whole documents are dealt over partitions once; postings, and scores by document, are then made without a further shuffle."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // DOCS_EACH)
    tokens = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).repartition(parts, "doc_id").select("doc_id", T.bm25_tokens("_text").alias("tokens"))
    each = tokens.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    if terms is not None:
        each = only_known(each, terms, "term")
    return each.groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf"))


def few(weighed: DataFrame, terms: DataFrame) -> DataFrame:
    """For a join that leaves postings where they are, if the terms are counted to be few."""
    return F.broadcast(weighed) if terms.count() <= BROADCAST_KEYS else weighed


def bm25_scores(terms: DataFrame, posts: DataFrame, stats: DataFrame, plus_one: bool = True) -> DataFrame:
    """Score of each query and document that share a term."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    weighed = terms.join(df, "term").join(F.broadcast(stats)).withColumn("idf", (N.idf if plus_one else N.okapi_idf)(F.col("n_docs"), F.col("df")) * F.col("qtf"))
    return posts.join(few(weighed, terms), "term").groupBy("query_id", "doc_id").agg(F.sum(N.bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))).alias("score"))


def top_k(scores: DataFrame, k: int, query: str = "query_id", ord_: str = "doc_id") -> DataFrame:
    """Best k by score, ties in corpus order. The window's limit is pushed below its shuffle."""
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), ord_))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def filled_top_k(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Top k where documents without a shared term score 0 and fill the list in corpus order: only the first k + found are needed."""
    found = top_k(scores, k)
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)
    fill = queries.select("query_id").join(F.broadcast(first)).join(scores.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(found.drop("rank").unionByName(fill), k)


def decremental_stats(corpus: DataFrame, excluded: DataFrame) -> DataFrame:
    """Documents and mean length per query without the query's excluded documents: totals less what goes, no index is rebuilt.

    corpus: doc_id, dl; excluded: query_id, doc_id."""
    total = corpus.agg(F.count("*").alias("n"), F.sum("dl").alias("len"))
    gone = excluded.join(corpus, "doc_id").groupBy("query_id").agg(F.count("*").alias("xn"), F.sum("dl").alias("xlen"))
    return gone.join(F.broadcast(total)).select("query_id", (F.col("n") - F.col("xn")).alias("n_docs"), F.try_divide((F.col("len") - F.col("xlen")).cast("double"), (F.col("n") - F.col("xn")).cast("double")).alias("avgdl"))


def restricted_scores(terms: DataFrame, posts: DataFrame, corpus: DataFrame, excluded: DataFrame, stats: DataFrame) -> DataFrame:
    """BM25 in which each query has a corpus without its excluded documents; df, N and mean length are exact for it."""
    # the queries that lack a document come to it as one list, so no query's terms meet all of its excluded documents
    lacking = excluded.groupBy("doc_id").agg(F.collect_set("query_id").alias("lacking"))
    posts = posts.join(lacking.hint("shuffle_hash"), "doc_id", "left")
    out = F.coalesce(F.array_contains("lacking", F.col("query_id")), F.lit(False))
    own = posts.join(few(terms, terms), "term").groupBy("query_id", "term", "qtf").agg(F.count_if(~out).alias("df"))
    base = stats.select(F.col("n_docs").alias("n0"), F.col("avgdl").alias("a0"))
    per = own.join(decremental_stats(corpus, excluded), "query_id", "left").join(F.broadcast(base))
    per = per.withColumns({"n_docs": F.coalesce("n_docs", "n0"), "avgdl": F.coalesce("avgdl", "a0")})
    weighed = per.where("df > 0").withColumn("idf", N.idf(F.col("n_docs"), F.col("df")) * F.col("qtf"))
    hits = posts.join(few(weighed.select("query_id", "term", "avgdl", "idf"), terms), "term").where(~out)
    return hits.groupBy("query_id", "doc_id").agg(F.sum(N.bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))).alias("score"))


def excluded_by_alias(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the normalised text holds a normalised alias as whole words.

    The alias's longest token is an equi-join key into the documents' tokens; the exact test
    follows on those candidates. queries: query_id, aliases; docs: doc_id, text."""
    alias = queries.select("query_id", F.explode(F.array_distinct(F.transform("aliases", T.normalize_answer))).alias("alias")).where("alias <> ''")
    key = F.element_at(F.array_sort(F.split("alias", "[^0-9a-z]+"), lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)), 1)
    alias = alias.withColumn("token", key)
    norm = docs.select("doc_id", T.normalize_answer("text").alias("norm"))
    tokens = norm.select("doc_id", F.explode(F.array_distinct(F.split("norm", "[^0-9a-z]+"))).alias("token"))
    candidate = tokens.join(alias, "token").select("query_id", "doc_id", "alias").distinct()
    return candidate.join(norm, "doc_id").where(T.contains_whole(F.col("norm"), F.col("alias"))).select("query_id", "doc_id").distinct()


def overlay(base: DataFrame, edited: DataFrame, k: int) -> DataFrame:
    """Top k after edited documents' scores replace or join the base hits. Both: query_id, doc_id, score."""
    new = edited.select("query_id", "doc_id", F.col("score").alias("new"))
    both = base.join(new, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", F.coalesce("new", "score").alias("score"))
    return top_k(both, k)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 4096, cosine: bool = False) -> DataFrame:
    """Exact inner-product (or cosine) search of a stated query set against all vectors.

    Queries are worked through in blocks of at most block_rows, which bounds what is
    broadcast; each task keeps its own best k per query, so the shuffle carries tasks x
    queries x k rows. Both: vec_id, embedding. Null vectors are left out."""
    rows = queries.where(F.col("embedding").isNotNull()).select("vec_id", "embedding").orderBy("vec_id")
    n = rows.count()
    out = None
    for at in range(0, n, block_rows):
        part = rows.offset(at).limit(block_rows).collect()
        ids = np.array([r["vec_id"] for r in part], np.int64)
        q = np.array([r["embedding"] for r in part], np.float32)
        if cosine:
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        held = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def search(batches, held=held):
            ids, q = held.value
            best_s, best_i = np.full((len(ids), 0), 0, np.float32), np.zeros((len(ids), 0), np.int64)
            for b in batches:
                keep = b.filter(b.column(1).is_valid())
                if not keep.num_rows:
                    continue
                step = max(1, SCORES_AT_ONCE // len(ids))
                for part in (keep.slice(a, step) for a in range(0, keep.num_rows, step)):
                    x = np.array(part.column(1).to_pylist(), np.float32)
                    if cosine:
                        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    s = np.hstack([best_s, (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.float32)])
                    i = np.hstack([best_i, np.tile(part.column(0).to_numpy(), (len(ids), 1))])
                    order = np.lexsort((i, -s), axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            m = best_s.shape[1]
            if m:
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(ids, m)), "doc_id": pa.array(best_i.ravel()), "score": pa.array(best_s.ravel().astype(np.float64))})

        found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(search, "query_id long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return top_k(out, k)


def gold_rank(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Rank of the first gold hit of each query, null where none was found. gold: query_id, doc_id."""
    found = hits.join(gold.withColumn("is_gold", F.lit(True)), ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg(F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("gold_rank"))


def retrieval_table(rows: DataFrame, *keys: str) -> DataFrame:
    """Recall before and after the edit, joint hits, retention given an original hit (null without one), and the drop."""
    o, s = F.col("orig_hit"), F.col("sub_hit")
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(o).alias("no"), F.count_if(s).alias("ns"), F.count_if(o & s).alias("nj"))
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 9)
    n = F.col("n")
    return g.select(*keys, "n", share(F.col("no"), n).alias("recall_orig"), share(F.col("ns"), n).alias("recall_sub"), share(F.col("nj"), n).alias("joint"), share(F.col("nj"), F.col("no")).alias("retention"), share(F.col("no") - F.col("ns"), n).alias("drop"))


def inner(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
