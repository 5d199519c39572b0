"""Named queries over the stored index of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.dense import DenseIndex, recall
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


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DenseIndex, DataFrame]:
    """A tenth of the vectors are reversed by an edit and others go by another."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    changed = v.where("vec_id % 10 = 3").select("vec_id", F.reverse("embedding").alias("embedding"))
    gone = v.where("vec_id % 17 = 5").select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))
    return DenseIndex.built(v).upserted(changed).upserted(gone), v.where("vec_id % 100 = 0")


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN list_reverse(embedding) ELSE embedding END AS e FROM embeddings WHERE vec_id % 17 <> 5), q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(q::DOUBLE[], e::DOUBLE[]), 6) AS score FROM q, e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, rank, round(score, 4) AS score FROM r WHERE rank <= 5""")
def edited_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact best five of an edited index of vectors, most of whose cells the bounds may skip."""
    index, queries = _edited(spark, sf_dir)
    return index.search(queries, 5)[0].select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query()
def dense_probe_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact best ten that a search by probes finds, against brute force over all vectors; the number of probes is measured on other vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = v.where("vec_id % 100 = 0")
    index = DenseIndex.built(v)
    found, said = index.search(queries, 10, probes=index.probes_for(v.where("vec_id % 100 <> 0"), 10))
    share = said.agg(F.avg(F.col("skipped") / F.col("cells")).alias("skipped"))
    return recall(found, R.dense_top_k(v, queries, 10)).join(F.broadcast(share))  # one row each
