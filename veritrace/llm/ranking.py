"""Places of rows within groups of any size: a range partitioning counts them, so no group has to fit into a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions_for, written

#: Bits that monotonically_increasing_id leaves for the place of a row within its partition.
_ROW_BITS = 33


def group_key(c: Column) -> Column:
    """A string for each value, never null: null comes first, others keep their bytewise order."""
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("="), c.cast("string")))


def ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with `ordinal` (of its key, from 0), `start` (rows of lesser keys), `size` (rows of its key) and `i` (place within its key, from 0).

    key holds a string that is never null. Rows are sorted over all partitions by key, `order` and at last by where they
    come from, so rows that repeat are spread too, and a key may have any share of the rows. What is joined is a row for
    each key and partition; the only window without keys has a row for each partition.
    """
    by = [key, *order, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions_for(df), *by).sortWithinPartitions(*by).drop("_tie")
    table = written(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    placed = table.withColumns({"_part": F.shiftright("_at", _ROW_BITS), "_row": F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("_at")
    pieces = written(placed.groupBy("_part", key).agg(F.min("_row").alias("row"), F.count("*").alias("n")), f"{name}-pieces")
    keys = pieces.groupBy(key).agg(F.min("_part").alias("_part"), F.min_by("row", "_part").alias("row"), F.sum("n").alias("size"))
    keys = keys.withColumn("nth", F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1)
    new = keys.groupBy("_part").agg(F.count("*").alias("new"))
    parts = pieces.groupBy("_part").agg(F.sum("n").alias("n")).join(new, "_part", "left")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    parts = parts.select("_part", earlier("n").alias("_start"), earlier("new").alias("keys"))
    keys = keys.join(parts, "_part").select(key, (F.col("_start") + F.col("row")).alias("start"), "size", (F.col("keys") + F.col("nth")).alias("ordinal"))
    spread = written(pieces.select("_part", key).join(keys, key).join(parts.select("_part", "_start"), "_part"), f"{name}-keys")
    out = placed.join(spread, ["_part", key]).withColumn("i", F.col("_start") + F.col("_row") - F.col("start"))
    return out.drop("_part", "_row", "_start")
