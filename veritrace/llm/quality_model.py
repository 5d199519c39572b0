"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL, scored as sparse dot products.

A text's features are its words and word pairs (a word that repeats the one before has a
pair of its own), hashed into 2**BITS columns, each with its count over the number of
words. The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, in the order
of a hash of doc_id); every text is scored whole. Null and empty texts have no features
and get the bias alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAME, WHITE, buffers, lean, least_by_hash, mixed, slices, word_spans
from .ftrl import Ftrl

BITS = 18
#: Labelled rows that a fit may use.
SAMPLE_ROWS = 6000
SCALE = 12.0
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(0x27D4EB2F165667C5)


def fold(doc_id, n: int):
    """crc32 of doc_id as text, modulo n; a null id belongs to no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column of each word and of each pair that begins with it (the last word of a text has none: column 2**BITS), and each text's first word."""
    _, _, h, first = word_spans(data, off, WHITE, SAME)
    shift = np.uint64(64 - BITS)
    one = (h >> shift).astype(np.int64)
    two = np.full(len(h), 1 << BITS, np.int64)
    if len(h) > 1:
        pair = np.where(h[1:] == h[:-1], _REPEAT, h[:-1] * _PAIR + h[1:])
        two[:-1] = (mixed(pair) >> shift).astype(np.int64)
        last = first[1:][first[1:] > first[:-1]] - 1
        two[last] = 1 << BITS
    return np.stack([one, two]), first


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # 2**BITS columns, then 0 for `no pair`
    bias: float

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        columns, first = features(data, off)
        total = np.concatenate([[0.0], np.cumsum(self.weights[columns[0]] + self.weights[columns[1]])])
        n = np.diff(first)
        return self.bias + SCALE * (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(data, off), -35, 35)))


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Sparse rows of at most `rows` labelled documents, in the order of a hash of doc_id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    chosen = least_by_hash(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y")), rows, "doc_id")

    @lean
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                columns, first = features(*buffers(b.column(b.schema.get_field_index("text"))))
                index, count = [], []
                for k in range(b.num_rows):
                    part = columns[:, first[k] : first[k + 1]].ravel()
                    i, c = np.unique(part[part < 1 << BITS], return_counts=True)
                    index.append(i.astype(np.int32).tobytes())
                    count.append((c * (SCALE / max(1, first[k + 1] - first[k]))).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(index, pa.binary()), pa.array(count, pa.binary()), b.column(2)], ["doc_id", "i", "v", "y"])

    # the sample is bounded by `rows`, so its ids may be broadcast
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    got = joined.mapInArrow(run, "doc_id long, i binary, v binary, y int").collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["i"])))
    return [(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32), r["y"]) for r in got]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, epochs: int = 3) -> Model:
    data = sampled(docs, labels, label, rows)
    model = Ftrl(1 << BITS, alpha=0.2, l1=1e-3, l2=1e-3).fit(data, epochs)
    w = model.weights()
    return Model(np.append(w[:-1, 0], 0.0), float(w[-1, 0]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches):
        m = held.value
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(*buffers(b.column(1))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """Rows of docs that score at least this much; docs' columns."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    @lean
    def run(batches):
        m = held.value
        for whole in batches:
            for b in slices(whole, "text"):
                yield b.filter(pa.array(m.scores(*buffers(b.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)


def learning_labels(labels: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fold."""
    return labels.where(fold(F.col("doc_id"), 5) != 0)


def digest(scores: DataFrame, least: float = 0.3) -> DataFrame:
    return scores.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
