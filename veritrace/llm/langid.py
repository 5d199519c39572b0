"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Lower-cased code points give n-grams of one to three characters, hashed into 2**BITS
columns. Document frequencies come from every learnable document; weights are trained by
FTRL with elastic-net penalties on a bounded sample (SAMPLE_ROWS, in the order of a hash of
doc_id), of which CALIBRATION is kept back to fit a temperature. Every text is scored whole,
in parts of CHUNK code points whose sums are added.
A text that is null or has no letter (Unicode's category L) is `und` with score 0.

Odd inputs. Each row gets a row, repeated doc_ids too; a doc_id that has two languages is
learned once for each. Ties of probability go to the language that sorts first, ties of
the sample's hash to the lesser doc_id. Very long texts are scored whole, in
memory of a few times their own size. Without learnable
rows every text is `und`. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, least_by_hash, slices
from .ftrl import Ftrl, softmax, temperature
from .quality_model import fold

BITS = 16
ORDERS = (1, 2, 3)
#: Labelled rows that a fit may use, and the share of them kept for the temperature.
SAMPLE_ROWS, CALIBRATION = 2400, 0.25
_LETTER = regex.compile(r"\p{L}")
_FACTOR = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


#: Code points that are looked at together; longer texts are cut, and their parts' sums added.
CHUNK = 1 << 18


def parts(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Groups of at most CHUNK code points: numbers of the texts, lower-cased parts of them, and how many n-grams start in each part.

    A part reaches as far beyond its own places as the longest n-gram that starts in them."""
    numbers, held, own, total = [], [], [], 0
    for k, text in enumerate(texts):
        low = text.lower()  # as a whole, as some letters depend on what is beside them
        for at in range(0, len(low), CHUNK):
            n = min(CHUNK, len(low) - at)
            if total + n > CHUNK:
                yield np.array(numbers), held, np.array(own, np.int64)
                numbers, held, own, total = [], [], [], 0
            numbers.append(k)
            held.append(low[at : at + n + ORDERS[-1] - 1])
            own.append(n)
            total += n
    if held:
        yield np.array(numbers), held, np.array(own, np.int64)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group of parts and each order: columns of its n-grams, and the number of the text that each belongs to."""
    for numbers, held, own in parts(texts):
        length = np.array([len(t) for t in held], np.int64)
        points = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.cumsum(length)
        owner = np.repeat(numbers, length)
        left = np.repeat(end, length) - np.arange(len(points))  # code points left in the part
        starts = left > np.repeat(length - own, length)
        for n in ORDERS:
            if len(points) < n:
                continue
            h = np.full(len(points) - n + 1, np.uint32(n), np.uint32)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * _FACTOR[k % 3]
                h ^= h >> np.uint32(15)
            inside = (left[: len(h)] >= n) & starts[: len(h)]
            yield (h[inside] >> np.uint32(32 - BITS)).astype(np.int64), owner[: len(h)][inside]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a text's n-grams and how often it has each."""
    total = np.zeros(1 << BITS, np.int64)
    for column, _ in grams([text]):
        total += np.bincount(column, minlength=1 << BITS)
    held = np.flatnonzero(total)
    return held, total[held]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each column, over all rows of docs; and their number."""

    @lean
    def run(batches):
        total, rows = np.zeros(1 << BITS, np.int64), 0
        for whole in batches:
            for b in slices(whole, "text", 1 << 18):
                for at in range(0, b.num_rows, 64):
                    texts = [t or "" for t in b.column(0).slice(at, 64).to_pylist()]
                    held = np.zeros((len(texts), 1 << BITS), bool)
                    for column, owner in grams(texts):
                        held[owner, column] = True
                    total += held.sum(0)
                    rows += len(texts)
        if rows:
            got = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.append(got, -1), pa.int64()), "n": pa.array(np.append(total[got], rows), pa.int64())})

    out, rows = np.zeros(1 << BITS, np.int64), 0
    for r in docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        if r["k"] < 0:
            rows = r["n"]
        else:
            out[r["k"]] = r["n"]
    return out, rows


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # a row for each column: weight x idf of each language, then idf
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        k = len(self.languages)
        total = np.zeros((len(texts), k + 1))
        for column, owner in grams(texts):
            if len(owner):
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                total[owner[first]] += np.add.reduceat(self.table[column], first, axis=0)
        return self.bias + total[:, :k] / np.maximum(total[:, k:], 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        p = softmax(self.logits([t or "" for t in texts]) / self.temperature) if self.languages else np.zeros((len(texts), 1))
        names = [self.languages[k] if t and self.languages and _LETTER.search(t) else "und" for t, k in zip(texts, p.argmax(1))]
        return names, np.where([n == "und" for n in names], 0.0, p.max(1))


#: Values are TF-IDF shares (they sum to one), so weights are learned at this scale.
_SCALE = 40.0


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = 3) -> Model:
    """docs: the learnable rows, with doc_id, text and lang."""
    learnable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    frequency, n = document_frequencies(learnable)
    idf = np.log((1 + n) / (1 + frequency)) + 0.05
    chosen = least_by_hash(learnable.select("doc_id", "lang").distinct(), rows, "doc_id", "lang")

    @lean
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                got = [counts(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())],
                    ["doc_id", "lang", "i", "c"],
                )

    # the sample is bounded by `rows`, so its ids may be broadcast
    sample = learnable.select("doc_id", "text", "lang").join(F.broadcast(chosen.withColumnRenamed("lang", "known")), "doc_id").where("lang = known").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    got = sorted(sample.mapInArrow(run, "doc_id long, lang string, i binary, c binary").collect(), key=lambda r: (r["doc_id"], r["lang"], bytes(r["i"])))
    names = sorted({r["lang"] for r in got})
    data = []
    for r in got:
        i, c = np.frombuffer(r["i"], np.int32), np.frombuffer(r["c"], np.int32)
        if len(i):
            v = c * idf[i]
            data.append((i, (v * (_SCALE / v.sum())).astype(np.float32), names.index(r["lang"])))
    np.random.default_rng(1).shuffle(data)
    cut = int(len(data) * (1 - CALIBRATION))
    k = max(2, len(names))
    model = Ftrl(1 << BITS, k, alpha=0.3, l1=2e-3, l2=1e-3).fit(data[:cut], epochs)
    w = model.weights()
    w, bias = w[:, : len(names)], w[-1, : len(names)]
    kept = data[cut:]
    logits = np.array([v @ w[i] + bias for i, v, _ in kept]).reshape(len(kept), len(names))
    t = temperature(logits, np.array([y for *_, y in kept], int)) if names else 1.0
    return Model(names, np.column_stack([w[:-1] * idf[:, None] * _SCALE, idf]).astype(np.float32), bias, t)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches):
        m = held.value
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                names, score = m.predict(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def learnable(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out fold."""
    return docs.where(fold(F.col("doc_id"), 4) != 2)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
