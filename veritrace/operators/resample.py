"""Resampling of items that have rows in many cells: one draw of items is shared by all cells of a space.

An item's rows become one vector, an array of (cell, sums); statistics of a replicate then depend on the sums of vectors
times how often each was drawn. Items with one vector are one pattern, so what is drawn is a count for each
pattern. Vectors hold whatever sums a statistic needs: arms, moments of a regression, cells of a histogram,
numerators and denominators of ratios. A space of one cell gives independent draws for each cell.

Two ways to draw: `hashed_sums` takes item numbers from hashes, which SQL can follow; `drawn_sums` draws multinomial counts
by numpy, chunk by chunk of patterns. Both give space, r, cell and the sums s0, s1, ...
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..sources.scratch import folder
from . import hashdraw as H
from .annotate import rank_within

#: Patterns of a chunk, and chunks of a space at most; then chunks grow.
CHUNK, MOST_CHUNKS = 2000, 1024
#: Items of a block that hashed draws fall into, at least and at most; counts of a block for all replicates, and draws of a partition.
LEAST_BLOCK, BLOCK, _COUNTS, _DRAWS = 1 << 9, 1 << 13, 1 << 23, 1 << 25
#: Entries of a matrix of counts, and items of a pattern on average up to which items are drawn one by one.
_ENTRIES, _FEW_ITEMS = 1 << 21, 3


def vectors(rows: DataFrame, space: Column | str, item: str, cell: Column, sums: list[Column]) -> DataFrame:
    """space, item, vector: an array of (cell, v) in the order of cells. An item's rows of one cell are added up first."""
    space = F.lit(space) if isinstance(space, str) else space
    rows = rows.select(space.alias("space"), F.col(item).alias("item"), cell.alias("cell"), *[c.cast("double").alias(f"s{k}") for k, c in enumerate(sums)])
    names = [f"s{k}" for k in range(len(sums))]
    rows = rows.repartition("space", "item")  # one shuffle for both groupings
    one = rows.groupBy("space", "item", "cell").agg(*[F.sum(n).alias(n) for n in names])
    return one.groupBy("space", "item").agg(F.array_sort(F.collect_list(F.struct("cell", F.array(*names).alias("v")))).alias("vector"))


def _added(rows: DataFrame, n: int, times: Column) -> DataFrame:
    each = rows.withColumn("x", F.explode("vector"))
    return each.groupBy("space", "r", "x.cell").agg(*[F.sum(F.col("x.v")[k] * times).alias(f"s{k}") for k in range(n)])


def point_sums(items: DataFrame, n: int) -> DataFrame:
    """The sums without resampling, as replicate -1."""
    return _added(items.withColumn("r", F.lit(-1)), n, F.lit(1))


def hashed_sums(items: DataFrame, n: int, b: int, tag: str) -> DataFrame:
    """Slot j of replicate r of a space draws the item number hash(tag, space, r, j) mod its items, which stand in the order of their names."""
    return placed_sums(items.select("space", F.col("item").cast("string").alias("item"), "vector"), n, b, tag)


def placed_sums(items: DataFrame, n: int, b: int, tag: str) -> DataFrame:
    """hashed_sums of items in their own order.

    A draw is two bytes, its place in a block of items; a task adds up the vectors of one block for all replicates, as the product
    of a matrix of counts and the block's values; the more replicates, the smaller its blocks. No item is sent to where draws are made, and none twice."""
    block = min(BLOCK, max(LEAST_BLOCK, _COUNTS // b))
    spark, path = items.sparkSession, folder(items.sparkSession, "vectors")
    items.write.parquet(path)  # read to rank, to count and to draw from
    items = spark.read.schema(items.schema).parquet(path)
    sizes = items.groupBy("space").agg(F.count("*").alias("items"))
    total = (sizes.agg(F.sum("items")).first()[0] or 0) * b
    prefix = F.concat_ws("|", F.lit(tag), "space", F.col("r").cast("string"), F.lit(""))
    draws = H.places_by_block(H.chunked(sizes, b, "items", prefix), "items", block)
    placed = rank_within(items, "space", "item").select("space", F.floor(F.col("place") / block).alias("block"), (F.col("place") % block).cast("int").alias("at"), "vector")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // _DRAWS)
    dealt = lambda df: df.repartition(parts, "space", "block").groupBy("space", "block")
    names = [f"s{k}" for k in range(n)]

    def added(key: tuple, own: pa.Table, drawn: pa.Table) -> pa.Table:
        vector, at = own["vector"].combine_chunks(), own["at"].to_numpy()
        counts = np.zeros((b, block))
        for r, places in zip(drawn["r"].to_pylist(), drawn["at"].to_pylist()):
            counts[r] += np.bincount(np.frombuffer(places, np.uint16), minlength=block)
        counts = counts[:, at]
        row = np.repeat(np.arange(len(at)), np.diff(vector.offsets.to_numpy()))
        cell, sums = vector.flatten().flatten()
        cell = cell.dictionary_encode("encode")
        code, sums = cell.indices.to_numpy(zero_copy_only=False), sums.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        out = []
        for k, name in enumerate(cell.dictionary.to_pylist()):
            mine = code == k
            times = counts[:, row[mine]]
            r = np.flatnonzero(times.any(axis=1))  # replicates that drew no item of a cell have no row of it
            got = times[r] @ np.nan_to_num(sums[mine])
            head = [pa.array([key[0].as_py()] * len(r), pa.string()), pa.array(r, pa.int32()), pa.array([name] * len(r), pa.string())]
            out.append(pa.table([*head, *[pa.array(got[:, i]) for i in range(n)]], names=["space", "r", "cell", *names]))
        return pa.concat_tables(out)

    sums = dealt(placed).cogroup(dealt(draws)).applyInArrow(added, "space string, r int, cell string, " + ", ".join(f"{c} double" for c in names))
    return sums.groupBy("space", "r", "cell").agg(*[F.sum(c).alias(c) for c in names])


def _pattern_counts(rng: np.random.Generator, n: np.ndarray, items: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Multinomial counts of patterns for each of n: where most patterns have few items, by drawing the items themselves, which
    costs less than a binomial for each pattern. As floats: products of integers do not use the fast path."""
    if items.sum() > _FEW_ITEMS * len(items):
        return rng.multinomial(n, p).astype(float)
    of = np.repeat(np.arange(len(items), dtype=np.int32), items)
    at = of[rng.integers(len(of), size=n.sum(), dtype=np.int32)] + np.repeat(np.arange(len(n), dtype=np.int32) * len(items), n)
    return np.bincount(at, minlength=len(n) * len(items)).reshape(len(n), -1).astype(float)


def drawn_sums(items: DataFrame, n: int, b: int = SETTINGS.bootstrap_b, seed: int = SETTINGS.seed) -> DataFrame:
    """Sums of b multinomial draws of as many items as there are.

    The items that each chunk of patterns gets in a replicate are one draw, which every task makes alike from the same
    seed; how they fall onto the chunk's patterns is another, made by the chunk alone.
    """
    spark, path = items.sparkSession, folder(items.sparkSession, "patterns")
    patterns = items.groupBy("space", "vector").agg(F.count("*").alias("items"))
    patterns.write.parquet(path)  # read to count, to size the chunks and to draw from
    patterns = spark.read.schema(patterns.schema).parquet(path)
    chunks = max(1, min(MOST_CHUNKS, patterns.count() // CHUNK))
    patterns = patterns.withColumn("chunk", F.pmod(F.xxhash64("vector"), F.lit(chunks)).cast("int"))
    counts: dict[str, dict[int, int]] = {}
    for row in patterns.groupBy("space", "chunk").agg(F.sum("items").alias("n")).orderBy("space", "chunk").collect():  # spaces x MOST_CHUNKS numbers at most
        counts.setdefault(row["space"], {})[row["chunk"]] = row["n"]
    names = [f"s{k}" for k in range(n)]
    schema = "space string, r int, cell string, " + ", ".join(f"{c} double" for c in names)

    def drawn(key, table):
        space, chunk = (x.as_py() for x in key)
        own = zlib.crc32((space or "").encode())
        share = counts[space]
        sizes = np.array([*share.values()])
        into = np.random.default_rng([seed, own]).multinomial(sizes.sum(), sizes / sizes.sum(), size=b)[:, [*share].index(chunk)]
        vector = table.column("vector").to_pylist()
        items_ = table.column("items").to_numpy()
        cells = sorted({x["cell"] for v in vector for x in v})
        at = {c: k for k, c in enumerate(cells)}
        values = np.zeros((len(vector), len(cells), n))
        for k, v in enumerate(vector):
            for x in v:
                values[k, at[x["cell"]]] = x["v"]
        values = values.reshape(len(vector), -1)
        order = np.lexsort(values.T[::-1])  # rows come in any order
        values, p = values[order], items_[order] / items_.sum()
        rng, out, step = np.random.default_rng([seed, own, chunk + 1]), [], max(1, _ENTRIES // len(vector))
        for a in range(0, b, step):
            out.append(_pattern_counts(rng, into[a : a + step], items_[order], p) @ values)
        sums = np.concatenate(out).reshape(-1, n)
        head = [pa.array([space] * len(sums), pa.string()), pa.array(np.repeat(np.arange(b), len(cells)), pa.int32()), pa.array(cells * b, pa.string())]
        return pa.table([*head, *[pa.array(sums[:, k]) for k in range(n)]], names=["space", "r", "cell", *names])

    parts = patterns.groupBy("space", "chunk").applyInArrow(drawn, schema)
    return parts.groupBy("space", "r", "cell").agg(*[F.sum(c).alias(c) for c in names])


def interval(reps: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, ci_low, ci_high (linear percentiles) and n_ok, the replicates with a value; undefined ones are left out and thereby counted."""
    cut = F.percentile(value, F.array(*map(F.lit, SETTINGS.ci)))
    return reps.groupBy(*keys).agg(F.round(cut[0], 9).alias("ci_low"), F.round(cut[1], 9).alias("ci_high"), F.count(value).alias("n_ok"))


def _ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


# --- statistics of sums


def slope_over_cells(sums: DataFrame, *keys: str) -> DataFrame:
    """Least squares over a replicate's cells of mean s2 on mean s1; s0 counts."""
    x, y = F.col("s1") / F.col("s0"), F.col("s2") / F.col("s0")
    return sums.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def best_cells(sums: DataFrame, *keys: str) -> DataFrame:
    """First best cell by s0 and by s1, and whether either has rivals of the same sum."""
    cells = F.array_sort(F.collect_list(F.struct("cell", "s0", "s1")))
    best = lambda s: F.filter("cells", lambda x: x[s] == F.array_max(F.transform("cells", lambda y: y[s])))
    found = sums.groupBy(*keys).agg(cells.alias("cells")).withColumns({"by0": best("s0"), "by1": best("s1")})
    first = lambda c: F.col(c)[0]["cell"]
    return found.select(*keys, first("by0").alias("best0"), first("by1").alias("best1"), ((F.size("by0") > 1) | (F.size("by1") > 1)).alias("tied"))


#: Sums of an item that within_regression needs, for predictors x and z and outcome y.
def moments(x: Column, z: Column, y: Column) -> list[Column]:
    return [F.lit(1), x, z, y, x * x, z * z, x * z, x * y, z * y]


def within_regression(sums: DataFrame, *keys: str) -> DataFrame:
    """Slope on x alone, and both slopes on x and z, of values centred within cells, from the sums of moments()."""
    s = [F.col(f"s{k}") for k in range(9)]
    less = lambda k, i, j: F.sum(s[k] - s[i] * s[j] / s[0])
    g = sums.groupBy(*keys).agg(less(4, 1, 1).alias("xx"), less(5, 2, 2).alias("zz"), less(6, 1, 2).alias("xz"), less(7, 1, 3).alias("xy"), less(8, 2, 3).alias("zy"))
    c = {n: F.when(F.abs(n) > 1e-9, F.col(n)).otherwise(F.lit(0.0)) for n in ("xx", "zz")}
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    det = F.when(F.abs(det) > 1e-9, det).otherwise(F.lit(0.0))
    return g.select(*keys, _ratio(F.col("xy"), c["xx"]).alias("slope"), _ratio(F.col("zz") * F.col("xy") - F.col("xz") * F.col("zy"), det).alias("slope_x"), _ratio(F.col("xx") * F.col("zy") - F.col("xz") * F.col("xy"), det).alias("slope_z"))


def weighted_spearman(histogram: DataFrame, x: str, y: str, w: str, *keys: str) -> DataFrame:
    """Rank correlation with ties at their mean from counts w of distinct (x, y); null where either side does not vary.

    keys must leave a small histogram; empty bins may be among its rows."""

    def ranked(v: str) -> DataFrame:
        from pyspark.sql import Window as W

        own = histogram.groupBy(*keys, v).agg(F.sum(w).alias("_n")).where("_n > 0")
        before = F.sum("_n").over(W.partitionBy(*keys).orderBy(v)) - F.col("_n")
        return own.select(*keys, v, (before + (F.col("_n") + 1) / 2).alias(f"_{v}"))

    h = histogram.where(F.col(w) > 0).join(ranked(x), [*keys, x]).join(ranked(y), [*keys, y])
    n, p, q = F.col(w), F.col(f"_{x}"), F.col(f"_{y}")
    g = h.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * p).alias("p"), F.sum(n * q).alias("q"), F.sum(n * p * p).alias("pp"), F.sum(n * q * q).alias("qq"), F.sum(n * p * q).alias("pq"))
    var = lambda s, t: F.col("n") * F.col(t) - F.col(s) * F.col(s)
    return g.select(*keys, _ratio(F.col("n") * F.col("pq") - F.col("p") * F.col("q"), F.sqrt(var("p", "pp") * var("q", "qq"))).alias("rho"))


def recapture(sums: DataFrame, *keys: str) -> DataFrame:
    """Rates of the total by two finders: s0 items, s1 and s2 found by each, s3 by both; null where none is found by both."""
    m = F.when(F.col("s3") > 0, F.col("s3"))
    return sums.select(*keys, (F.col("s1") * F.col("s2") / m / F.col("s0")).alias("rate"), (((F.col("s1") + 1) * (F.col("s2") + 1) / (m + 1) - 1) / F.col("s0")).alias("rate_chapman"))


def ratio_change(sums: DataFrame, *keys: str) -> DataFrame:
    """s2 / s3 - s0 / s1: the change between two samples that draw the same clusters, each with its own size."""
    return sums.select(*keys, (_ratio(F.col("s2"), F.col("s3")) - _ratio(F.col("s0"), F.col("s1"))).alias("change"))
