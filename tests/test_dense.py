"""The stored index of vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrace.operators import dense
from veritrace.operators.dense import DenseIndex, recall

SCHEMA = "vec_id long, embedding array<float>"


def clusters(seed, n, dims=8, groups=12):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, dims)) * 3
    x = (middle[r.integers(groups, size=n)] + 0.2 * r.normal(size=(n, dims))).astype(np.float32)
    x[: n // 3] = x[0]  # a third of all vectors are copies
    return {i: v for i, v in enumerate(x)}


def plain(vectors, q, k):
    s = sorted((-round(float(np.float64(q) @ np.float64(v)), 6), i) for i, v in vectors.items())
    return [(i, -x + 0.0) for x, i in s[:k]]


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vectors.items()], SCHEMA)


def hits(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 16)
    monkeypatch.setattr(dense, "QUERY_ROWS", 3)


def test_search_is_exact_and_skips(spark, small):
    v = clusters(1, 300)
    index = DenseIndex.built(frame(spark, v), cells=20)
    asked = {i: v[i] for i in (0, 120, 150, 180, 210, 240, 299)}
    found, said = index.search(frame(spark, asked), 5)
    got = hits(found)
    for i, q in asked.items():
        want = plain(v, q, 5)
        assert [d for d, _ in got[i]] == [d for d, _ in want]
        assert np.allclose([s for _, s in got[i]], [s for _, s in want], atol=2e-6)
    said = said.collect()
    assert len(said) == len(asked) and all(0 <= r["skipped"] <= r["cells"] for r in said) and sum(r["skipped"] for r in said) > 0
    # more hits asked for than there are vectors: every cell is open and all come back
    assert len(hits(index.search(frame(spark, {7: v[7]}), 400)[0])[7]) == 300


def test_edits_equal_a_new_index(spark, small):
    v = clusters(2, 200)
    index = DenseIndex.built(frame(spark, v), cells=15)
    changed = {3: -v[3], 150: v[150] * 4, 500: v[199] * 2}
    again = {150: v[10], 501: v[20]}
    gone = {4: None, 999: None}
    index = index.upserted(frame(spark, changed)).upserted(frame(spark, gone)).upserted(frame(spark, again))
    now = {i: x for i, x in (v | changed | again).items() if i not in gone}
    asked = {i: v[i] for i in (0, 3, 100, 150, 199)}
    got = hits(index.search(frame(spark, asked), 6)[0])
    for i, q in asked.items():
        assert [d for d, _ in got[i]] == [d for d, _ in plain(now, q, 6)]


def test_odd_vectors_and_empty_tables(spark, small):
    rows = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, []), (4, [None, 1.0]), (5, [0.0, 2.0]), (6, [0.0, 0.0])]
    odd = spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit("clash"))
    index = DenseIndex.built(odd)
    assert hits(index.search(odd, 9)[0]) == {1: [(1, 1.0), (5, 0.0), (6, 0.0)], 5: [(5, 4.0), (1, 0.0), (6, 0.0)], 6: [(1, 0.0), (5, 0.0), (6, 0.0)]}
    assert [d for d, _ in hits(DenseIndex.built(odd, unit=True).search(odd, 1)[0])[5]] == [5]
    none = odd.where("false")
    assert index.search(none, 3)[0].count() == 0
    empty = DenseIndex.built(none)
    assert empty.search(odd, 3)[0].count() == 0
    assert hits(empty.upserted(odd).search(odd, 1)[0])[5] == [(5, 4.0)]


def test_recall_counts_the_exact_hits(spark):
    exact = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "query_id long, doc_id long")
    found = spark.createDataFrame([(1, 1), (1, 9), (2, 3), (2, 4)], "query_id long, doc_id long")
    assert recall(found, exact).collect()[0].asDict() == {"n_queries": 2, "recall": 0.75}


def test_probes_find_most(spark, small):
    v = clusters(3, 300)
    index = DenseIndex.built(frame(spark, v), cells=20)
    queries = frame(spark, {i: v[i] for i in range(110, 300, 20)})
    exact = index.search(queries, 5)[0]
    probes = index.probes_for(frame(spark, {i: v[i] for i in range(111, 300, 9)}), 5)
    assert 1 <= probes < 15  # of 20 cells
    assert recall(index.search(queries, 5, probes=probes)[0], exact).collect()[0]["recall"] >= 0.9
