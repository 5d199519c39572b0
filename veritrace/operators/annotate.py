"""Sampling for annotation, merging two annotators, and seeded subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SETTINGS
from . import gates as V


#: Buckets of a global rank.
RANK_BUCKETS = 256


def global_rank(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Rows with their place, from 0, in the order of the columns, without gathering them in one task.

    The first column's range is cut at keys of a bounded sample; a row's place is its place
    within its bucket after the rows of the buckets before, whose numbers alone come to the
    driver. Null keys come first. Rows equal in all columns are placed in any order.
    """
    key = F.col(order[0])
    sample = rows.where(key.isNotNull()).select(key).orderBy(F.xxhash64(key)).limit(RANK_BUCKETS - 1).collect()
    bounds = sorted({r[0] for r in sample})
    cut = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= key)) if bounds else F.lit(0)
    held = rows.withColumn("_bucket", F.when(key.isNull(), F.lit(-1)).otherwise(cut))
    before, at = [], 0
    for r in sorted(held.groupBy("_bucket").count().collect(), key=lambda r: r["_bucket"]):
        before += [F.lit(r["_bucket"]), F.lit(at).cast("long")]
        at += r["count"]
    offset = F.create_map(*before)[F.col("_bucket")] if before else F.lit(0).cast("long")
    within = F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1
    return held.withColumn(name, offset + within).drop("_bucket")


#: Buckets of a rank within spaces; each row is compared with that many keys.
_WITHIN_BUCKETS = 64


def rank_within(rows: DataFrame, space: str, key: str, name: str = "place") -> DataFrame:
    """Rows with their place, from 0, in the order of key within their space; no space is gathered in one task.

    As global_rank; rows before a bucket are joined from a table of spaces x buckets. Rows are read three times.
    """
    of = F.col(key)
    sample = rows.where(of.isNotNull()).select(space, key).orderBy(F.xxhash64(space, key)).limit(8 * _WITHIN_BUCKETS).collect()
    known = sorted({r[1] for r in sample})
    bounds = known[:: max(1, -(-len(known) // (_WITHIN_BUCKETS - 1)))]
    cut = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= of)) if bounds else F.lit(0)
    held = rows.withColumn("_bucket", F.when(of.isNull(), F.lit(-1)).otherwise(cut))
    sizes = held.groupBy(space, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col(space).alias("_space"), F.col("_bucket").alias("_at"), (F.sum("_n").over(W.partitionBy(space).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy(space, "_bucket").orderBy(key)) - 1
    placed = held.withColumn("_within", within).join(F.broadcast(before), F.col(space).eqNullSafe(F.col("_space")) & (F.col("_bucket") == F.col("_at")))
    return placed.withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_space", "_at", "_before", "_within")


def systematic(rows: DataFrame, n: int, key: str) -> DataFrame:
    """n rows at even steps through the key's order: the floor(i * N / n)-th for each i."""
    total = rows.count()
    if total <= n:
        return rows
    # the i whose place is this row's, if any
    i = F.ceil(F.col("place") * F.lit(n) / F.lit(total)).cast("long")
    return global_rank(rows, key).where((i < n) & (F.floor(i * F.lit(total) / F.lit(n)) == F.col("place"))).drop("place")


def seeded_rank(key: Column, seed: int = SETTINGS.seed) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


def subset(rows: DataFrame, n: int, key: str, seed: int = SETTINGS.seed, exclude: DataFrame | None = None) -> DataFrame:
    """n rows by a seeded hash of the key, without the excluded keys."""
    left = rows if exclude is None else rows.join(exclude.select(key).distinct(), key, "left_anti")
    return left.orderBy(seeded_rank(F.col(key), seed), key).limit(n)


def split(rows: DataFrame, sizes: dict[str, int], key: str, seed: int = SETTINGS.seed) -> DataFrame:
    """Disjoint named parts by a seeded hash; what is left over is `rest`."""
    name, lo = F.when(F.lit(False), ""), 0
    for part, n in sizes.items():
        name, lo = name.when((F.col("place") >= lo) & (F.col("place") < lo + n), part), lo + n
    placed = global_rank(rows.withColumn("_hash", seeded_rank(F.col(key), seed)), "_hash", key)
    return placed.withColumn("part", name.otherwise("rest")).drop("place", "_hash")


def merged(a: DataFrame, b: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Tasks of both annotators; where they agree (also in having no label) the label is adjudicated."""
    both = a.select("task_id", *[F.col(d).alias(f"{d}_a") for d in dimensions]).join(b.select("task_id", *[F.col(d).alias(f"{d}_b") for d in dimensions]), "task_id")
    same = F.lit(True)
    for d in dimensions:
        same = same & F.col(f"{d}_a").eqNullSafe(F.col(f"{d}_b"))
    return both.withColumn("adjudicated", same)


def agreement(both: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Kappa of each dimension over tasks that both labelled."""
    rows = None
    for d in dimensions:
        part = both.where(F.col(f"{d}_a").isNotNull() & F.col(f"{d}_b").isNotNull()).select(F.lit(d).alias("dimension"), F.col(f"{d}_a").alias("x"), F.col(f"{d}_b").alias("y"))
        rows = part if rows is None else rows.unionByName(part)
    return V.kappa(rows, "dimension")
