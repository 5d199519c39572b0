"""Resampling over spaces of cells: the law of multinomial draws, and statistics against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrace.operators import resample as Z

ROWS = "space string, item long, cell string, x double, y double"


def made(spark, n=300, seed=1):
    r = np.random.default_rng(seed)
    rows = [("s", i, c, float(x), float(r.integers(0, 3) - x)) for i in range(n) for c, x in zip("abc", r.integers(0, 2, 3)) if c != "c" or i % 3]
    return rows, spark.createDataFrame(rows, ROWS)


def vectors(df):
    return Z.vectors(df, F.col("space"), "item", F.col("cell"), [F.lit(1), F.col("x"), F.col("y")])


@pytest.mark.parametrize("chunk", [2000, 3])
def test_law_of_drawn_sums(spark, monkeypatch, chunk):
    """Mean and covariance of 10,000 draws are those of a draw of whole items, however patterns fall into chunks."""
    monkeypatch.setattr(Z, "CHUNK", chunk)
    rows, df = made(spark)
    items = vectors(df).cache()
    got = Z.drawn_sums(items, 3, 10_000).toPandas()
    wide = got.pivot(index="r", columns="cell", values=["s0", "s1", "s2"]).to_numpy()
    assert wide.shape == (10_000, 9) and set(got.space) == {"s"}
    one = np.zeros((300, 9))
    for _, i, c, x, y in rows:
        one[i, ["abc".index(c), 3 + "abc".index(c), 6 + "abc".index(c)]] = 1, x, y
    mean, cov = one.sum(0), 300 * np.cov(one.T, bias=True)
    assert (wide[:, 0] == 300).all() and (wide[:, 1] == 300).all()  # every item is in both cells
    assert np.abs(wide.mean(0) - mean).max() < 0.05 * np.sqrt(np.diag(cov)).max()
    assert np.abs(np.cov(wide.T, bias=True) - cov).max() < 0.06 * np.diag(cov).max()
    again = Z.drawn_sums(items.repartition(7), 3, 10_000).toPandas().pivot(index="r", columns="cell", values=["s0", "s1", "s2"]).to_numpy()
    assert np.allclose(wide, again)


def test_hashed_sums_by_hand(spark):
    import hashlib

    rows, df = made(spark, 40)
    got = {(r.r, r.cell): (r.s0, r.s1, r.s2) for r in Z.hashed_sums(vectors(df), 3, 5, "t").collect()}
    names = sorted(range(40), key=str)
    for rep in range(5):
        drawn = [names[int(hashlib.md5(f"t|s|{rep}|{j}".encode()).hexdigest()[:8], 16) % 40] for j in range(1, 41)]
        for c in "abc":
            own = [(x, y) for i in drawn for _, k, e, x, y in rows if (k, e) == (i, c)]
            assert got[rep, c] == pytest.approx((len(own), sum(x for x, _ in own), sum(y for _, y in own)))


def test_within_regression_is_least_squares_on_centred_values(spark):
    r = np.random.default_rng(4)
    n = 90
    g, x, z = r.integers(0, 3, n), r.normal(size=n), r.normal(size=n)
    y = 2 * x - z + g + r.normal(size=n)
    df = spark.createDataFrame([("s", i, str(g[i]), float(x[i]), float(z[i]), float(y[i])) for i in range(n)], "space string, item int, cell string, x double, z double, y double")
    sums = Z.point_sums(Z.vectors(df, F.col("space"), "item", F.col("cell"), Z.moments(F.col("x"), F.col("z"), F.col("y"))), 9)
    got = Z.within_regression(sums, "r").first()
    centre = lambda v: v - np.array([v[g == k].mean() for k in range(3)])[g]
    cx, cz, cy = centre(x), centre(z), centre(y)
    both = np.linalg.lstsq(np.column_stack([cx, cz]), cy, rcond=None)[0]
    assert got.slope == pytest.approx(np.linalg.lstsq(cx[:, None], cy, rcond=None)[0][0]) and (got.slope_x, got.slope_z) == pytest.approx(tuple(both))
    flat = Z.point_sums(Z.vectors(df, F.col("space"), "item", F.col("cell"), Z.moments(F.lit(1.0), F.col("z"), F.col("y"))), 9)
    assert Z.within_regression(flat, "r").select("slope", "slope_x").first() == (None, None)


def test_spearman_of_a_histogram(spark):
    r = np.random.default_rng(6)
    x, y = r.integers(0, 5, 400), r.integers(-1, 2, 400)
    mid = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    df = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in zip(x, y)], "x int, y int, w double").groupBy(F.lit(1).alias("k"), "x", "y").agg(F.sum("w").alias("w"))
    assert Z.weighted_spearman(df, "x", "y", "w", "k").first().rho == pytest.approx(np.corrcoef(mid(x), mid(y))[0, 1])
    assert Z.weighted_spearman(df.withColumn("x", F.lit(1)), "x", "y", "w", "k").first().rho is None


def test_best_cells_recapture_and_ratios(spark):
    sums = spark.createDataFrame([(0, "a", 3.0, 1.0), (0, "b", 3.0, 2.0), (1, "a", 5.0, 4.0), (1, "b", 2.0, 1.0)], "r int, cell string, s0 double, s1 double")
    assert {tuple(x) for x in Z.best_cells(sums, "r").collect()} == {(0, "a", "b", True), (1, "a", "a", False)}
    found = spark.createDataFrame([(0, 100.0, 10.0, 8.0, 4.0), (1, 100.0, 10.0, 8.0, 0.0)], "r int, s0 double, s1 double, s2 double, s3 double")
    reps = Z.recapture(found, "r")
    assert [tuple(x) for x in reps.orderBy("r").collect()] == [(0, pytest.approx(0.2), pytest.approx((11 * 9 / 5 - 1) / 100)), (1, None, None)]
    assert Z.interval(reps.withColumn("k", F.lit(0)), "rate", "k").first().n_ok == 1
    two = spark.createDataFrame([(0, 2.0, 4.0, 3.0, 5.0), (1, 0.0, 0.0, 3.0, 5.0)], "r int, s0 double, s1 double, s2 double, s3 double")
    assert [x.change for x in Z.ratio_change(two, "r").orderBy("r").collect()] == [pytest.approx(0.1), None]


def test_intervals_of_hashes_and_draws_agree(spark):
    _, df = made(spark, 200, 3)
    items = vectors(df)
    mean = lambda sums: sums.where("cell = 'a'").select(F.lit("k").alias("k"), (F.col("s2") / F.col("s0")).alias("v"))
    h, d = (Z.interval(mean(s), "v", "k").first() for s in (Z.hashed_sums(items, 3, 400, "t"), Z.drawn_sums(items, 3, 10_000)))
    width = d.ci_high - d.ci_low
    assert abs(h.ci_low - d.ci_low) < 0.25 * width and abs(h.ci_high - d.ci_high) < 0.25 * width


@pytest.mark.parametrize("prefix", ["", "t|s|3|", "x" * 52, "x" * 55, "x" * 130])
def test_heads_are_md5(prefix):
    import hashlib

    from veritrace.operators import hashdraw as H

    for lo, hi in ((1, 1200), (99_990, 100_020)):
        assert H.heads(prefix.encode(), lo, hi).tolist() == [int(hashlib.md5(f"{prefix}{j}".encode()).hexdigest()[:8], 16) for j in range(lo, hi)]


def test_draws_leave_tasks_as_blocks(spark, monkeypatch):
    """Rows do not grow with draws: before, each of 40,000 draws was a row that was shuffled; results stay the same for small blocks and chunks."""
    from veritrace.operators import hashdraw as H

    spaces = spark.createDataFrame([("s", 10_000)], "space string, n long")
    rows = H.places_by_block(H.chunked(spaces, 4, "n", F.concat(F.lit("t|s|"), F.col("r"), F.lit("|"))), "n", 4096).collect()
    assert len(rows) == 4 * 3 and sum(len(x["at"]) for x in rows) == 2 * 40_000
    items = vectors(made(spark, 40)[1]).cache()
    whole = {tuple(x) for x in Z.hashed_sums(items, 3, 5, "t").collect()}
    monkeypatch.setattr(Z, "BLOCK", 8)
    monkeypatch.setattr(H, "SLOTS", 16)
    assert {tuple(x) for x in Z.hashed_sums(items, 3, 5, "t").collect()} == whole


def test_pattern_counts_leave_tasks_as_counts(spark):
    """Means of a resample come from a row of counts for each chunk of slots, and are those of whole items."""
    import hashlib

    from veritrace.operators import stats as B

    values = [1, 0, 0, 1, None, 0, 1]
    df = spark.createDataFrame([("m", v) for v in values], "g string, v int")
    got = {x.r: x.v for x in B.replicate_means(df, ["g"], ["v"], {"v": F.col("v")}, 6, "t").collect()}
    order = sorted(values, key=lambda v: (v is not None, v))
    for r in range(6):
        drawn = [order[int(hashlib.md5(f"t|m|{r}|{j}".encode()).hexdigest()[:8], 16) % 7] for j in range(1, 8)]
        known = [v for v in drawn if v is not None]
        assert got[r] == pytest.approx(sum(known) / len(known))


def test_counts_of_rare_patterns_are_drawn_by_items():
    rng, items, n = np.random.default_rng(5), np.array([1, 2, 1, 4, 1]), np.array([9, 0, 3] * 20_000)
    got = Z._pattern_counts(rng, n, items, items / items.sum())
    assert got.shape == (len(n), 5) and (got.sum(1) == n).all()
    p = items / items.sum()
    nine = got[::3]
    assert np.allclose(nine.mean(0), 9 * p, atol=0.05) and np.allclose(np.cov(nine.T), 9 * (np.diag(p) - np.outer(p, p)), atol=0.06)


def test_patterns_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(k, "c", k % 5) for k in range(60)], "item int, cell string, v int").mapInArrow(counted, "item int, cell string, v int")
    Z.drawn_sums(Z.vectors(rows, "s", "item", F.col("cell"), [F.lit(1), F.col("v")]), 2, 50).collect()
    assert seen.value == 60
