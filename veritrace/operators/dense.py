"""A stored index of vectors by cells, searched exactly by bounds or by a number of probes, and edited without a rebuild.

Centroids are fitted on a bounded sample; every vector belongs to the cell of its nearest one. A cell keeps the greatest distance
of its members from the centroid, so that no member's inner product with a query q exceeds q.c + |q| * radius. An exact search
visits the cells nearest to each query, takes the k-th score found there as its threshold, and then visits only cells whose
bound reaches it. A search by probes stops after
a number of visits that `probes_for` measures for a recall.

Cells are split into blocks of about BLOCK_ROWS by a hash of the vector's id, and the queries of a cell into groups of about
QUERY_ROWS, so that a task holds one block and one group however large a cell is. Edited vectors are a segment of
their own: they join the cells that exist, and what they replace is masked at read.

Ids must be unique within a build or an edit. Null ids and vectors that are null, empty or hold a null are left out; an edit
with such a vector takes its id out. Ties go to the lesser id.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval as R
from .postings import _stored

#: Cells are the square root of the number of vectors, at most MOST_CELLS; the fit reads SAMPLE_PER_CELL vectors for each.
MOST_CELLS, SAMPLE_PER_CELL, ROUNDS = 4096, 32, 8
BLOCK_ROWS, QUERY_ROWS = 2048, 1024
#: Cells of a query that are visited before there is a threshold.
FIRST_CELLS = 4
#: Share of the exact hits that probes are to find, and the vectors that their number is measured on.
TARGET_RECALL, CALIBRATION = 0.95, 256
_HITS = "query_id long, doc_id long, score double"


def _usable(vectors: DataFrame, unit: bool) -> DataFrame:
    """vec_id and embedding (array of double) of whole vectors, of length one where `unit`."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.where("vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x))")
    if unit:
        length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
        v = v.withColumn("length", length).select("vec_id", F.transform("embedding", lambda x: x / F.greatest("length", F.lit(1e-12))).alias("embedding"))
    return v


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and how far it is."""
    cell = np.argmin((centroids**2).sum(1) - 2 * (x @ centroids.T), axis=1)
    return cell, np.linalg.norm(x - centroids[cell], axis=1)


def fitted(vectors: DataFrame, cells: int) -> np.ndarray:
    """Centroids from the cells * SAMPLE_PER_CELL vectors of the least hashes. Equal vectors count once, so copies take no cells."""
    least = vectors.select("embedding", F.xxhash64("embedding").alias("h")).groupBy("h").agg(F.any_value("embedding").alias("embedding"))
    sample = np.array([r["embedding"] for r in least.orderBy("h").limit(cells * SAMPLE_PER_CELL).collect()])  # bounded by the limit
    if not len(sample):
        return np.zeros((0, 0))
    centroids = sample[:cells].copy()
    for _ in range(ROUNDS):
        cell, _far = _nearest(sample, centroids)
        n = np.bincount(cell, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, cell, sample)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


@dataclass(frozen=True)
class DenseIndex:
    """vectors: segment, cell, vec_id, embedding, far; cells: cell, radius, n; masked: segment, vec_id of what later segments replaced."""

    centroids: np.ndarray
    vectors: DataFrame
    cells: DataFrame
    masked: DataFrame
    unit: bool = False
    segments: int = 1

    @classmethod
    def built(cls, vectors: DataFrame, cells: int | None = None, unit: bool = False) -> DenseIndex:
        """An index of all vectors; with `unit`, of their directions (cosine)."""
        usable = _usable(vectors, unit)
        if cells is None:
            cells = int(np.clip(np.sqrt(usable.count()), 1, MOST_CELLS))
        centroids = fitted(usable, cells)
        held = _placed(usable, centroids, 0)
        none = vectors.sparkSession.createDataFrame([], "segment int, vec_id long")
        return cls(centroids, held, _measured(held), none, unit)

    def upserted(self, vectors: DataFrame) -> DenseIndex:
        """With new or changed vectors; a null vector takes its id out. Only what changes is written."""
        spark = vectors.sparkSession
        ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
        gone = self.vectors.select("segment", "vec_id").join(ids, "vec_id", "left_semi").select("segment", "vec_id")
        gone = _stored(spark, gone.join(self.masked, ["segment", "vec_id"], "left_anti"), "dense-masked")
        usable = _usable(vectors, self.unit)
        centroids = self.centroids if len(self.centroids) else fitted(usable, 1)
        added = _placed(usable, centroids, self.segments)
        # a radius may stay too large after a removal, never too small
        both = self.cells.unionByName(_measured(added)).groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
        return replace(self, centroids=centroids, vectors=self.vectors.unionByName(added), cells=both, masked=self.masked.unionByName(gone), segments=self.segments + 1)

    def _visits(self, queries: DataFrame, cells: DataFrame, most: int | None) -> DataFrame:
        """query_id, embedding, cell, place: the `most` cells of the highest centroid scores, or else those past them whose bound reaches `least`.

        Centroids and radii are at most MOST_CELLS rows."""
        held = {r["cell"]: r["radius"] for r in cells.collect()}
        known = np.array(sorted(held), np.int32)
        data = queries.sparkSession.sparkContext.broadcast((known, self.centroids[known], np.array([held[c] for c in known])))
        first = FIRST_CELLS if most is None else most

        def run(batches):
            known, centroids, radius = data.value
            for b in batches:
                if not b.num_rows or not len(known):
                    continue
                q = _matrix(b.column(1))
                near = q @ centroids.T
                order = np.lexsort((np.broadcast_to(known, near.shape), -near), axis=1)
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.broadcast_to(np.arange(len(known)), order.shape), 1)
                if most is None:
                    least = b.column(2).to_numpy(zero_copy_only=False)
                    bound = near + np.linalg.norm(q, axis=1)[:, None] * radius
                    # sums in another order differ by far less than this margin
                    go = (place >= first) & ~(bound < (least - 1e-6 - 1e-9 * np.abs(least))[:, None])
                else:
                    go = place < first
                at, cell = np.nonzero(go)
                for lo in range(0, len(at), 4096):
                    part = at[lo : lo + 4096]
                    to = cell[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(part)), b.column(1).take(pa.array(part)), pa.array(known[to]), pa.array(place[part, to], pa.int32())], ["query_id", "embedding", "cell", "place"])

        columns = ["query_id", "embedding"] + (["least"] if most is None else [])
        return queries.select(*columns).mapInArrow(run, "query_id long, embedding array<double>, cell int, place int")

    def _scored(self, visits: DataFrame, cells: DataFrame, k: int, digits: int) -> DataFrame:
        """The best k of each visited block for each query."""
        blocks = lambda n, rows: F.ceil(n / rows).cast("int")
        asked = visits.groupBy("cell").agg(F.count("*").alias("q"))
        # as many rows as there are cells, which MOST_CELLS bounds
        sizes = F.broadcast(cells.join(F.broadcast(asked), "cell").select("cell", blocks(F.col("n"), BLOCK_ROWS).alias("blocks"), blocks(F.col("q"), QUERY_ROWS).alias("groups")))
        part = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = self.vectors.join(sizes, "cell").join(self.masked, ["segment", "vec_id"], "left_anti")
        left = left.select("cell", part(F.col("vec_id"), F.col("blocks")).alias("block"), every(F.col("groups")).alias("grp"), "vec_id", "embedding")
        right = visits.join(sizes, "cell").select("cell", every(F.col("blocks")).alias("block"), part(F.col("query_id"), F.col("groups")).alias("grp"), "query_id", "embedding")

        def best(x: pa.Table, q: pa.Table) -> pa.Table:
            out = {"query_id": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "score": np.zeros(0)}
            if x.num_rows and q.num_rows:
                ids = x.column("vec_id").to_numpy()
                score = np.round(_matrix(q.column("embedding")) @ _matrix(x.column("embedding")).T, digits) + 0.0
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                out = {"query_id": np.repeat(q.column("query_id").to_numpy(), order.shape[1]), "doc_id": ids[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()}
            return pa.table(out)

        keys = ("cell", "block", "grp")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, _HITS)

    def probes_for(self, sample: DataFrame, k: int, target: float = TARGET_RECALL) -> int:
        """The least number of probes that finds the share `target` of the exact best k, measured over at most CALIBRATION vectors
        of `sample` (those of the least hashes). A vector of the index is no hit of its own."""
        chosen = _usable(sample, self.unit).orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION)
        chosen = _stored(sample.sparkSession, chosen, "dense-calibration")
        live = self.vectors.join(self.masked, ["segment", "vec_id"], "left_anti")
        exact = R.dense_top_k(live.select("vec_id", "embedding"), chosen, k + 1).where("query_id <> doc_id")
        exact = R.top_k(exact.drop("rank"), k).select("query_id", F.col("doc_id").alias("vec_id"))
        place = self._visits(chosen.withColumnRenamed("vec_id", "query_id"), self.cells, MOST_CELLS).select("query_id", "cell", "place")
        hits = exact.join(live.select("vec_id", "cell"), "vec_id").join(place, ["query_id", "cell"]).groupBy("place").agg(F.count("*").alias("n"))
        rows = sorted((r["place"], r["n"]) for r in hits.collect())  # at most MOST_CELLS rows
        total, so_far = sum(n for _, n in rows), 0
        for at, n in rows:
            so_far += n
            if so_far >= target * total:
                return at + 1
        return 1

    def search(self, queries: DataFrame, k: int, probes: int | None = None, digits: int = 6) -> tuple[DataFrame, DataFrame]:
        """The best k (query_id, doc_id, score, rank), exact unless `probes` bounds the cells of a query; and query_id, cells, skipped.

        queries: vec_id, embedding, each id once."""
        spark = queries.sparkSession
        q = _stored(spark, _usable(queries, self.unit).withColumnRenamed("vec_id", "query_id"), "dense-queries")
        cells = _stored(spark, self.cells, "dense-cells")
        n_cells = cells.count()
        visits = _stored(spark, self._visits(q, cells, FIRST_CELLS if probes is None else probes), "dense-visits")
        found = _stored(spark, R.top_k(self._scored(visits, cells, k, digits), k), "dense-first")
        if probes is None:
            least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            # without k hits there is no threshold: all cells are open
            open_ = q.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
            more = _stored(spark, self._visits(open_, cells, None), "dense-more")
            found = R.top_k(found.drop("rank").unionByName(self._scored(more, cells, k, digits)), k)
            visits = visits.unionByName(more)
        read = visits.groupBy("query_id").agg(F.count("*").alias("read"))
        said = q.select("query_id").join(read, "query_id", "left").select("query_id", F.lit(n_cells).alias("cells"), (F.lit(n_cells) - F.coalesce("read", F.lit(0))).alias("skipped"))
        return found, said


def _placed(usable: DataFrame, centroids: np.ndarray, segment: int) -> DataFrame:
    data = usable.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            if b.num_rows:
                cell, far = _nearest(_matrix(b.column(1)), data.value)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), b.column(1), pa.array(far, pa.float64())], ["cell", "vec_id", "embedding", "far"])

    placed = usable.mapInArrow(run, "cell int, vec_id long, embedding array<double>, far double")
    return _stored(usable.sparkSession, placed.withColumn("segment", F.lit(segment)), "dense-vectors")


def _measured(placed: DataFrame) -> DataFrame:
    return placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of the exact hits that were found."""
    hit = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
