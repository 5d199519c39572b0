"""A stored inverted index: postings by blocks of documents with their maxima, exact top k that skips blocks, and edits without a rebuild.

A block is a range of documents' places. For each term and block the index keeps the largest count and the least length, which
bound what the term can add to any document of the block. A search scores the blocks of the highest bounds first;
the k-th score found there is a threshold that most other blocks cannot reach, and those are never read. Edits
go to a segment of their own, with the old postings of the edited documents masked at read; statistics move by the difference.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..sources.scratch import folder
from . import retrieval as R

#: Documents of a block, and blocks of a query that are scored before there is a threshold.
BLOCK_DOCS, FIRST_BLOCKS = 64, 4
#: Documents that a task deals with at once, by whole blocks.
TASK_DOCS = 8192
_PLACE = ["segment", "block"]


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _block(doc_id: str = "doc_id") -> Column:
    return F.floor(F.col(doc_id) / BLOCK_DOCS)


def _parts(docs: DataFrame) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // TASK_DOCS)


@dataclass(frozen=True)
class Index:
    """postings: segment, term, block, most_tf, least_dl, n, posts (of doc_id, tf, dl): a term's postings in a block under their maxima.

    documents: segment, doc_id, dl; masked: segment, doc_id of what later segments took the place of. Whole texts are dealt by blocks once; after that a
    block's postings are made, and added up, where the block is, and no posting is shuffled by its term."""

    postings: DataFrame
    documents: DataFrame
    masked: DataFrame
    parts: int
    segments: int = 1

    @classmethod
    def built(cls, docs: DataFrame) -> Index:
        """docs: doc_id, text. Null texts are no documents."""
        parts = _parts(docs)
        posts, documents = _segment(docs, 0, parts)
        return cls(posts, documents, docs.sparkSession.createDataFrame([], documents.select("segment", "doc_id").schema), parts)

    def upserted(self, docs: DataFrame) -> Index:
        """With new or changed documents; a null text takes its document out. Only what changes is written."""
        spark, parts = docs.sparkSession, _parts(docs)
        posts, documents = _segment(docs, self.segments, parts)
        gone = self.documents.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("segment", "doc_id")
        gone = _stored(spark, gone.join(self.masked, ["segment", "doc_id"], "left_anti"), "index-masked")
        return replace(
            self,
            postings=self.postings.unionByName(posts),
            documents=self.documents.unionByName(documents),
            masked=self.masked.unionByName(gone),
            parts=max(self.parts, parts),
            segments=self.segments + 1,
        )

    def _with_masks(self, postings: DataFrame, how: str) -> DataFrame:
        """postings dealt by blocks, with the masked documents of each block: gone."""
        gone = self.masked.groupBy("segment", _block().alias("block")).agg(F.collect_list("doc_id").alias("gone"))
        return postings.repartition(self.parts, *_PLACE).join(gone.repartition(self.parts, *_PLACE).hint("shuffle_hash"), _PLACE, how)

    def live(self, postings: DataFrame) -> DataFrame:
        """segment, term, block, posts: dealt by blocks, without masked documents."""
        own = self._with_masks(postings.select("segment", "term", "block", "posts"), "left")
        hit = F.coalesce(F.arrays_overlap("posts.doc_id", "gone"), F.lit(False))
        kept = F.when(hit, F.filter("posts", lambda p: ~F.array_contains("gone", p["doc_id"]))).otherwise(F.col("posts"))
        return own.select("segment", "term", "block", kept.alias("posts"))

    def stats(self) -> DataFrame:
        """One row: documents and mean length."""
        whole = self.documents.agg(F.count("*").alias("n"), F.sum("dl").alias("len"))
        less = self.documents.join(self.masked, ["segment", "doc_id"]).agg(F.count("*").alias("xn"), F.coalesce(F.sum("dl"), F.lit(0)).alias("xlen"))
        n = F.col("n") - F.col("xn")
        return whole.join(F.broadcast(less)).select(n.alias("n_docs"), F.try_divide((F.col("len") - F.col("xlen")).cast("double"), n.cast("double")).alias("avgdl"))  # one row each

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """term, df of the given terms: sums over blocks, less the postings that are masked."""
        own = R.only_known(self.postings, terms, "term")
        known = own.groupBy("term").agg(F.sum("n").alias("n"))
        if self.segments == 1:  # nothing is masked
            return known.select("term", F.col("n").alias("df"))
        held = self._with_masks(own.select("segment", "term", "block", F.col("posts.doc_id").alias("ids")), "inner")
        lost = held.select("term", "gone", F.explode("ids").alias("doc_id")).where(F.array_contains("gone", F.col("doc_id"))).groupBy("term").agg(F.count("*").alias("x"))
        return known.join(lost, "term", "left").select("term", (F.col("n") - F.coalesce("x", F.lit(0))).alias("df"))

    def weights(self, queries: DataFrame, key: str, text: str) -> DataFrame:
        """query_id, term, idf (times the term's count in the query), avgdl."""
        terms = R.query_terms(queries, key, text)
        w = terms.join(self.frequencies(terms).where("df > 0"), "term").join(F.broadcast(self.stats()))  # one row
        return w.select("query_id", "term", "avgdl", (N.idf(F.col("n_docs"), F.col("df")) * F.col("qtf")).alias("idf"))

    def bounds(self, weights: DataFrame) -> DataFrame:
        """query_id, segment, block, bound: no document of the block scores more."""
        each = self.postings.select("segment", "term", "block", "most_tf", "least_dl").join(R.few(weights, weights), "term")
        most = N.bm25_term(F.col("most_tf"), F.col("least_dl"), F.col("avgdl"), F.col("idf"))
        return each.groupBy("query_id", "segment", "block").agg(F.sum(most).alias("bound"))

    def scores(self, weights: DataFrame, blocks: DataFrame) -> DataFrame:
        """query_id, doc_id, score over the given (query_id, segment, block). Sums are made where a block's postings were dealt to."""
        own = self.live(R.only_known(R.only_known(self.postings, weights, "term"), blocks, "block"))
        asked = blocks.groupBy(_PLACE).agg(F.collect_list("query_id").alias("asked")).repartition(self.parts, *_PLACE)
        wanted = own.join(asked.hint("shuffle_hash"), _PLACE).join(R.few(weights, weights), "term").where(F.array_contains("asked", F.col("query_id")))
        hits = wanted.select("query_id", *_PLACE, "idf", "avgdl", F.inline("posts"))
        # a document is live in one segment
        return hits.groupBy("query_id", *_PLACE, "doc_id").agg(F.sum(N.bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))).alias("score")).drop(*_PLACE)

    def search(self, queries: DataFrame, key: str, text: str, k: int, digits: int = 9) -> tuple[DataFrame, DataFrame]:
        """The exact best k (query_id, doc_id, score, rank), ties in corpus order, and query_id, blocks, skipped."""
        spark = queries.sparkSession
        weights = _stored(spark, self.weights(queries, key, text), "index-weights")
        best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block"))
        bounds = _stored(spark, self.bounds(weights).withColumn("place", best), "index-bounds")
        best_of = lambda s: R.top_k(s.withColumn("score", F.round("score", digits)), k)
        first = _stored(spark, best_of(self.scores(weights, bounds.where(F.col("place") <= FIRST_BLOCKS))), "index-first")
        least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        more = bounds.where(F.col("place") > FIRST_BLOCKS).join(least, "query_id", "left")
        # a bound is a sum in another order than a score: the margin is far above what that can differ by
        open_ = F.col("least").isNull() | (F.col("bound") >= F.col("least") * (1 - 1e-9) - 10.0**-digits)
        more = _stored(spark, more.where(open_).select("query_id", "segment", "block"), "index-more")
        top = R.top_k(first.unionByName(best_of(self.scores(weights, more))).drop("rank"), k)
        read = bounds.where(F.col("place") <= FIRST_BLOCKS).select("query_id").unionByName(more.select("query_id")).groupBy("query_id").agg(F.count("*").alias("read"))
        said = bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(read, "query_id")
        return top, said.select("query_id", "blocks", (F.col("blocks") - F.col("read")).alias("skipped"))


def _segment(docs: DataFrame, number: int, parts: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    held = docs.where(F.col("text").isNotNull()).select("doc_id", _block().alias("block"), "text")
    dl = F.size(T.bm25_tokens("text"))
    documents = _stored(spark, held.select(F.lit(number).alias("segment"), "doc_id", dl.alias("dl")), "index-documents")
    tokens = held.repartition(parts, "block").select("block", "doc_id", T.bm25_tokens("text").alias("tokens"))
    each = tokens.select("block", "doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("block", "doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    posts = each.groupBy("block", "term").agg(F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.count("*").alias("n"), F.collect_list(F.struct("doc_id", "tf", "dl")).alias("posts"))
    return _stored(spark, posts.select(F.lit(number).alias("segment"), "term", "block", "most_tf", "least_dl", "n", "posts"), "index-postings"), documents
