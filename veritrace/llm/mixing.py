"""Mixing sources to target weights with soft domain membership.

A softmax classifier fitted on the labelled table gives every document a posterior over
domains. Nonnegative document rates r are then fitted so that the expected domain totals
sum_i r_i * tokens_i * p_i[k] match the target totals, by projected-gradient least
squares. Each step needs one sum over the table of posteriors (documents stay where they
are; K numbers come back), and a document's rate follows from the K step vectors so far.

A step carries Nesterov's momentum. In the metric that weighs a rate by its document's tokens, and with each domain's error
divided by the domain's own total, the step size 1 is stable and the error shrinks by a
factor that depends on how far the posteriors overlap, not on the number of documents.

Documents without tokens keep the starting rate. A target for a domain that has no tokens
cannot be met and is left out. Repeated rows are documents of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_model as qm
from .common import buffers, lean, slices, written
from .ftrl import Ftrl, softmax

#: Labelled rows that the classifier may use.
SAMPLE_ROWS = 6000
#: Share of all tokens to draw, and the weight of each domain (quality, toxic) in it.
#: The domain model reads shares of words this many times as strongly as the quality model: toxic words are few.
FOCUS = 10.0
TOTAL_SHARE = 0.5
TARGETS = {(1, 0): 0.94, (0, 0): 0.03, (1, 1): 0.02, (0, 1): 0.01}
STEPS, TOLERANCE, STALLED = 60, 1e-4, 1e-3


@dataclass(frozen=True)
class Posteriors:
    domains: list
    weights: np.ndarray  # 2**BITS + 1 rows
    bias: np.ndarray

    def of(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and posteriors of each text."""
        columns, first = qm.features(data, off)
        n = np.diff(first)
        total = np.zeros((len(n), len(self.domains)))
        if not self.domains:
            return n, total
        some = np.flatnonzero(n)
        if len(some):
            rows = self.weights[columns[0]] + self.weights[columns[1]]
            total[some] = np.add.reduceat(rows, first[:-1][some], axis=0)
        return n, softmax(self.bias + FOCUS * qm.SCALE * total / np.maximum(n, 1)[:, None])


def fit_posteriors(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = 3) -> Posteriors:
    """labels: doc_id, quality, toxic; a domain is a pair of the two."""
    coded = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("domain"))
    data = qm.sampled(docs, coded, "domain", rows)
    codes = sorted({y for *_, y in data})
    k = max(2, len(codes))
    w = Ftrl(1 << qm.BITS, k, alpha=0.2, l1=1e-3, l2=1e-3).fit([(i, v * FOCUS, codes.index(y)) for i, v, y in data], epochs).weights()
    table = np.vstack([w[:-1, : len(codes)], np.zeros((1, len(codes)))]).astype(np.float32)
    return Posteriors([divmod(c, 2) for c in codes], table, w[-1, : len(codes)])


def posteriors(docs: DataFrame, model: Posteriors) -> DataFrame:
    """doc_id, n_tokens (words) and p of each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches):
        m = held.value
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                n, p = m.of(*buffers(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def rates(p: np.ndarray, n_tokens: np.ndarray, start: float, steps: list[list[float]], ahead: float | None = None) -> np.ndarray:
    """Documents' rates after these steps: each is a momentum and a vector over the domains. With `ahead`, the point at
    which the next gradient is taken, under that momentum."""
    r = old = np.full(len(p), start)
    for momentum, *vector in steps:
        r, old = np.maximum(0.0, r + momentum * (r - old) + p @ np.array(vector)), r
    if ahead is not None:
        r = r + ahead * (r - old)
    return np.where(n_tokens > 0, r, start)


def _matrix(column, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


@dataclass(frozen=True)
class Fit:
    start: float
    steps: list
    targets: list
    totals: list


def fit_rates(table: DataFrame, weights: list[float], total_share: float = TOTAL_SHARE, steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """table: n_tokens and p, kept in storage; weights: the share of each domain in the mix.

    Projected gradient with Nesterov's momentum, which starts again where the error grows."""
    k = len(weights)

    names = [f"t{i}" for i in range(k)]

    def totals(start: float, taken: list, ahead: float | None = None) -> np.ndarray:
        @lean
        def run(batches):
            total = np.zeros(k)
            for b in batches:
                n, p = b.column(0).to_numpy(), _matrix(b.column(1), k)
                total += (rates(p, n, start, taken, ahead) * n) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names)

        row = table.select("n_tokens", "p").mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names]).first()
        return np.array([float(x) for x in row])

    have = totals(1.0, [])
    can = have > 0
    share = np.where(can, weights, 0.0)
    share = share / share.sum() if share.sum() else share
    want = share * have.sum() * total_share
    scale = np.where(can, 1 / np.where(can, have, 1.0), 0.0)
    taken: list[list[float]] = []
    losses: list[float] = []
    got, momentum, age, before = have * total_share, 0.0, 1.0, np.inf
    for _ in range(steps):
        error = want - got
        if np.abs(error).sum() <= tolerance * max(want.sum(), 1e-300):
            break
        loss = float((scale * error * error).sum())
        losses.append(loss)
        if len(losses) > 8 and losses[-9] - min(losses[-8:]) <= STALLED * losses[-9]:
            break
        taken.append([momentum, *(error * scale).tolist()])
        if loss > before:
            age = 1.0
        older, age = age, (1 + (1 + 4 * age * age) ** 0.5) / 2
        momentum, before = (older - 1) / age, loss
        got = totals(total_share, taken, momentum)
    if taken:
        got = totals(total_share, taken)
    return Fit(total_share, taken, want.tolist(), got.tolist())


def mixed(docs: DataFrame, labels: DataFrame, targets: dict = TARGETS, total_share: float = TOTAL_SHARE) -> DataFrame:
    """One row for each document: doc_id, n_tokens, its likeliest domain and posterior, its rate, and copies, which
    rounds the rate by a hash of doc_id so that copies have the rate as their mean."""
    model = fit_posteriors(docs, labels)
    held = written(posteriors(docs, model), "mixing")
    if not model.domains:
        return held.select("doc_id", "n_tokens", F.lit(None).cast("string").alias("domain"), F.lit(0.0).alias("posterior"), F.lit(total_share).alias("rate"), F.lit(0).cast("long").alias("copies"))
    fit = fit_rates(held, [targets.get(d, 0.0) for d in model.domains], total_share)
    k, domains = len(model.domains), model.domains

    @lean
    def run(batches):
        for b in batches:
            n, p = b.column(1).to_numpy(), _matrix(b.column(2), k)
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f"quality{domains[i][0]}_toxic{domains[i][1]}" for i in best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(rates(p, n, fit.start, fit.steps))], ["doc_id", "n_tokens", "domain", "posterior", "rate"])

    unit = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << 30)) / float(1 << 30)
    out = held.select("doc_id", "n_tokens", "p").mapInArrow(run, "doc_id long, n_tokens long, domain string, posterior double, rate double")
    return out.withColumn("copies", F.floor(F.col("rate") + unit).cast("long"))
