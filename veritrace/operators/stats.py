"""Resampling, exact tests, multiple comparisons, regression and decisions.

Resampling never moves items. A replicate of paired items is a draw of counts over the
sixteen arm patterns, so items are first aggregated to patterns; what follows has a size of
replicates times patterns, whatever the number of items. Draws come from hashes, so that
every engine and every run has the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import numeric as N
from . import hashdraw as H
from .resample import placed_sums


def patterns(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Items by group and pattern of values, with the range of item numbers [lo, hi) that a pattern holds."""
    counts = rows.groupBy(*keys, *values).agg(F.count("*").alias("items"))
    w = W.partitionBy(*keys).orderBy(*values)
    hi = F.sum("items").over(w.rowsBetween(W.unboundedPreceding, 0))
    return counts.select(*keys, *values, "items", (hi - F.col("items")).alias("lo"), hi.alias("hi"), F.sum("items").over(W.partitionBy(*keys)).alias("n"))


def replicate_means(rows: DataFrame, keys: list[str], values: list[str], gains: dict[str, Column], b: int, tag: str) -> DataFrame:
    """Mean of each gain in each of b resamples with replacement, for each group.

    Slot j of replicate r draws the item number hash(tag, group, r, j) mod n; its pattern is
    the one whose range holds that number.
    """
    ranges = patterns(rows, keys, values).groupBy(*keys).agg(F.max("n").cast("long").alias("n"), F.array_sort(F.collect_list(F.struct("hi", *values))).alias("p"))
    prefix = F.concat_ws("|", F.lit(tag), *[F.col(k).cast("string") for k in keys], F.col("r").cast("string"), F.lit(""))
    slots = H.chunked(ranges.withColumn("ends", F.col("p.hi")), b, "n", prefix)
    hit = H.pattern_counts(slots, "ends", "n").select(*keys, "r", F.explode(F.arrays_zip("p", "times")).alias("x")).select(*keys, "r", "x.p.*", "x.times").where("times > 0")
    mean = lambda g: F.sum(g * F.col("times")) / F.sum(F.when(g.isNotNull(), F.col("times")))
    return hit.groupBy(*keys, "r").agg(*[mean(g).alias(name) for name, g in gains.items()])


def multinomial_means(rows: DataFrame, keys: list[str], values: list[str], gains: dict, b: int = SETTINGS.bootstrap_b, seed: int = SETTINGS.seed) -> DataFrame:
    """The same law at a cost that does not depend on the number of items: pattern counts are multinomial.

    gains: name -> function of a dict of numpy columns. A group's patterns are at most the product of the values' levels.
    """
    import numpy as np
    import pandas as pd

    def draw(key, pdf):
        own = np.random.default_rng([seed, *"|".join(map(str, key)).encode()])
        c = pdf["items"].to_numpy()
        drawn = own.multinomial(c.sum(), c / c.sum(), size=b)
        cols = {v: pdf[v].to_numpy(float) for v in values}
        out = pd.DataFrame({k: [x] * b for k, x in zip(keys, key)} | {"r": np.arange(b)})
        for name, f in gains.items():
            out[name] = drawn @ f(cols) / c.sum()
        return out

    cells = patterns(rows, keys, values).orderBy(*keys, *values)
    schema = ", ".join([*(f"{k} {dict(cells.dtypes)[k]}" for k in keys), "r int", *(f"{g} double" for g in gains)])
    return cells.groupBy(*keys).applyInPandas(lambda key, pdf: draw(key, pdf.sort_values(values)), schema)


def order_ci(replicates: DataFrame, keys: list[str], value: str, ci: tuple[float, float] = SETTINGS.ci) -> DataFrame:
    """Order statistics floor(q * b), from 0, of each group's replicates."""
    at = lambda q: F.element_at("v", F.least(F.size("v"), F.floor(F.lit(q) * F.size("v")).cast("int") + 1))
    return replicates.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("v")).select(*keys, F.round(at(ci[0]), 9).alias("ci_low"), F.round(at(ci[1]), 9).alias("ci_high"))


def linear_ci(replicates: DataFrame, keys: list[str], value: str, ci: tuple[float, float] = SETTINGS.ci) -> DataFrame:
    """Interpolated percentiles of each group's replicates."""
    return replicates.groupBy(*keys).agg(F.round(F.percentile(value, F.lit(ci[0])), 9).alias("ci_low"), F.round(F.percentile(value, F.lit(ci[1])), 9).alias("ci_high"))


def flip_probability(replicates: DataFrame, keys: list[str], config: str, by: Column) -> DataFrame:
    """Share of replicates whose best configuration by apparent gain is not the best by corrected gain; ties go to the least `by`.

    Independent draws are those keyed by the configuration; paired ones share the slot's item.
    """
    best = lambda v: F.max_by(config, F.struct(F.col(v), -by))
    per = replicates.groupBy(*keys, "r").agg(best("apparent").alias("app"), best("corrected").alias("cor"))
    return per.groupBy(*keys).agg(F.count("*").alias("replicates"), F.round(F.avg((F.col("app") != F.col("cor")).cast("int")), 9).alias("p_flip"))


def sensitive(p_flip: Column, lo_a: Column, hi_a: Column, lo_c: Column, hi_c: Column) -> Column:
    """Change is advised if the best flips often and the corrected-gain intervals of the two bests are apart."""
    return (p_flip > SETTINGS.flip_threshold) & ((hi_a < lo_c) | (hi_c < lo_a))


def exact_tests(pairs: DataFrame, *keys: str) -> DataFrame:
    """McNemar's exact test, which on 0/1 pairs is the sign test without ties. pairs: x, y."""
    g = pairs.groupBy(*keys).agg(F.count_if(F.col("x") < F.col("y")).alias("up"), F.count_if(F.col("x") > F.col("y")).alias("down"))
    return g.select(*keys, "up", "down", N.binomial_two_sided(F.least("up", "down"), F.col("up") + F.col("down")).alias("p"))


def adjusted(tests: DataFrame, *family: str, order: str) -> DataFrame:
    """Holm's and Benjamini-Hochberg's p-values within each family; ties by `order`."""
    every = W.partitionBy(*family)
    up = every.orderBy("p", order)
    down = every.orderBy(F.desc("p"), F.desc(order))
    m, rank = F.count("*").over(every), F.row_number().over(up)
    ranked = tests.withColumns({"m": m, "rank": rank})
    return ranked.select(
        *[c for c in tests.columns if c != "p"],
        F.round("p", 12).alias("p"),
        F.round(F.least(F.lit(1.0), F.max((F.col("m") - F.col("rank") + 1) * F.col("p")).over(up.rowsBetween(W.unboundedPreceding, 0))), 12).alias("p_holm"),
        F.round(F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("rank")).over(down.rowsBetween(W.unboundedPreceding, 0))), 12).alias("p_bh"),
    )


def average_rank(value: str, *partition: str) -> Column:
    """Rank with ties at their mean."""
    w = W.partitionBy(*partition)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*partition, value)) - 1) / 2.0


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null where either side does not vary."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def centred(value: str, *partition: str) -> Column:
    return F.col(value) - F.avg(value).over(W.partitionBy(*partition))


def two_predictors(rows: DataFrame, y: str, x1: str, x2: str, *keys: str) -> DataFrame:
    """Least squares on two predictors by their covariances."""
    cov = lambda p, q: F.covar_samp(p, q)
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), cov(x1, x1).alias("s11"), cov(x2, x2).alias("s22"), cov(x1, x2).alias("s12"), cov(x1, y).alias("s1y"), cov(x2, y).alias("s2y"), cov(y, y).alias("syy"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = F.try_divide(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), det)
    b2 = F.try_divide(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), det)
    r2 = F.try_divide(b1 * F.col("s1y") + b2 * F.col("s2y"), F.col("syy"))
    return g.select(*keys, "n", F.round(b1, 9).alias("beta1"), F.round(b2, 9).alias("beta2"), F.round(r2, 9).alias("r2"))


def quartile_bins(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Mean of y by half-open quartile of x (linear percentiles)."""
    cuts = rows.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    v = F.col(x)
    bin_ = F.when(v < F.col("q")[0], 1).when(v < F.col("q")[1], 2).when(v < F.col("q")[2], 3).otherwise(4)
    both = rows.join(F.broadcast(cuts), list(keys)) if keys else rows.join(F.broadcast(cuts))
    return both.withColumn("quartile", bin_).groupBy(*keys, "quartile").agg(F.count("*").alias("n"), F.round(F.avg(y), 9).alias("mean_y"))


def capture_recapture(n1: Column, n2: Column, m: Column) -> tuple[Column, Column]:
    """Lincoln-Petersen (null at m = 0) and Chapman estimates of the total."""
    return F.try_divide(n1.cast("double") * n2, m.cast("double")), (n1 + 1.0) * (n2 + 1) / (m + 1) - 1


def cluster_means(rows: DataFrame, keys: list[str], cluster: str, value: str, b: int, tag: str) -> DataFrame:
    """Mean of value in each of b resamples of whole clusters, for each group.

    Members are first summed by cluster; a replicate draws as many clusters as there are."""
    total = rows.groupBy(*keys, cluster).agg(F.sum(value).cast("double").alias("s"), F.count(value).cast("double").alias("m"))
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    items = total.select(name.alias("space"), F.col(cluster).alias("item"), F.array(F.struct(F.to_json(F.struct(*keys)).alias("cell"), F.array(F.coalesce("s", F.lit(0.0)), "m").alias("v"))).alias("vector"))
    sums = placed_sums(items, 2, b, tag)
    own = F.from_json("cell", total.select(*keys).schema)
    return sums.select(own.alias("x"), "r", F.try_divide(F.when(F.col("s1") > 0, F.col("s0")), F.col("s1")).alias(value)).select("x.*", "r", value)


def cluster_multinomial_means(rows: DataFrame, keys: list[str], cluster: str, value: str, b: int = SETTINGS.bootstrap_b, seed: int = SETTINGS.seed) -> DataFrame:
    """The law of cluster_means from the counts of clusters with one sum and one size; value's sums are whole numbers of few levels."""
    total = rows.groupBy(*keys, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("m")).where("m > 0")
    reps = multinomial_means(total, keys, ["s", "m"], {"s": lambda x: x["s"], "m": lambda x: x["m"]}, b, seed)
    return reps.select(*keys, "r", F.try_divide("s", "m").alias(value))
