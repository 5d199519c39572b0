"""Numeric expressions: bins, BM25 parts, intervals, verdicts, exact binomial tails and hashing."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SETTINGS


def magnitude_bin(c: Column) -> Column:
    """Digits of the integer part; 0 for 0, -1 for what is no number."""
    x = F.abs(F.replace(c, F.lit(","), F.lit("")).try_cast("double"))
    return F.coalesce(F.when(x == 0, 0).otherwise(F.length(F.floor(x).cast("decimal(38,0)").cast("string"))), F.lit(-1))


def year(c: Column) -> Column:
    """A year from 1000 to 2100, else null."""
    y = F.trim(c).try_cast("int")
    return F.when(F.trim(c).rlike(r"^[0-9]{4}$") & y.between(1000, 2100), y)


def era(c: Column, width: int = SETTINGS.era_width) -> Column:
    return F.floor(year(c) / width).cast("int")


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency that is never negative."""
    return F.log1p((n - df + 0.5) / (df + 0.5))


def okapi_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, dl: Column, avgdl: Column, idf_: Column, k1: float = SETTINGS.bm25_k1, b: float = SETTINGS.bm25_b) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval for k of n, within 0 and 1; null for n = 0."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    grown = 1 + F.try_divide(F.lit(z * z), n.cast("double"))
    middle = p + F.try_divide(F.lit(z * z / 2), n.cast("double"))
    half = z * F.sqrt(F.try_divide(p * (1 - p), n.cast("double")) + F.try_divide(F.lit(z * z / 4), n.cast("double") * n))
    some = n > 0  # greatest and least pass over nulls
    return F.when(some, F.greatest(F.lit(0.0), (middle - half) / grown)), F.when(some, F.least(F.lit(1.0), (middle + half) / grown))


def z_sum(power: float = SETTINGS.power, alpha: float = SETTINGS.alpha) -> float:
    normal = NormalDist()
    return normal.inv_cdf(power) + normal.inv_cdf(1 - alpha / 2)


def n_required(variance: Column, delta: float) -> Column:
    return F.when(variance <= 0, F.lit(0)).otherwise(F.ceil(variance * (z_sum() ** 2 / delta**2))).cast("long")


def verdict(value: Column, go: Column | float | None, abandon: float, direction: str, enough: Column) -> Column:
    """GO, REVISE or ABANDON by where the value lies, or INSUFFICIENT; null values are insufficient."""
    better = (lambda x, y: x <= y) if direction == "lower" else (lambda x, y: x >= y)
    out = F.when(~F.coalesce(enough, F.lit(False)) | value.isNull(), "INSUFFICIENT")
    if go is not None:
        out = out.when(better(value, F.lit(go) if not isinstance(go, Column) else go), "GO")
    return out.when(~better(value, F.lit(abandon)), "ABANDON").otherwise("REVISE")


def sequential(estimate: Column, seen: Column) -> Column:
    first, go, abandon = SETTINGS.sequential
    return F.when(seen < first, "CONTINUE").when(estimate < go, "GO").when(estimate > abandon, "ABANDON").otherwise("CONTINUE")


def binomial_two_sided(k: Column, n: Column) -> Column:
    """min(1, 2 P(X <= k)) for X ~ Binomial(n, 1/2), summed in log space; 1 for n = 0.

    Terms follow from each other by ratio, so no factorial is formed.
    """
    start = F.struct((n * F.lit(-math.log(2))).alias("term"), F.lit(0.0).alias("sum"))
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), k).cast("long"))
    folded = F.aggregate(
        steps,
        start,
        lambda a, i: F.struct((a["term"] + F.when(i < n, F.log((n - i) / (i + 1).cast("double"))).otherwise(F.lit(0.0))).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum")),
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * folded["sum"]))


def hash_mod(text: Column, n: Column) -> Column:
    """SHA-256 of text modulo n, for n below 2**31: Horner's rule over eight words of the digest."""
    digest = F.sha2(text, 256)
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    shift = F.lit(1 << 32).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: F.pmod(a * F.pmod(shift, n) + F.pmod(w, n), n))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from an MD5 of the parts: the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") / float(1 << 32)


def vram_gb(params_b: Column, bits: Column, ctx: Column, layers: int = 36, kv_heads: int = 8, head_dim: int = 128) -> Column:
    """Weights, key-value cache at two bytes, and 1.2 GB of overhead."""
    return params_b * bits / 8 + ctx * F.lit(2.0 * 2 * layers * kv_heads * head_dim) / 1e9 + 1.2


def within(lo: Column, hi: Column, delta: float) -> Column:
    """Equivalence: the interval lies inside (-delta, delta)."""
    return (lo > -delta) & (hi < delta)
