"""Controlled edits: locating an answer, validating a proposal, rewriting one span, and the ledger of failures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as T

_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("value", StringType())]))

_CHANGE = StructType([StructField(n, IntegerType()) for n in ("start", "old_end", "new_end")])


def _spans_of(text: str | None, values) -> list[tuple[int, int, str]]:
    import re

    found, text = [], text or ""
    for v in values if values is not None else []:
        if not v:
            continue
        hits = [m.span() for m in re.finditer(rf"(?<![0-9A-Za-z]){re.escape(v)}(?![0-9A-Za-z])", text)]
        if not hits:
            at = text.find(v)
            while at >= 0:
                hits.append((at, at + len(v)))
                at = text.find(v, at + 1)
        found += [(s, e, v) for s, e in hits]
    return sorted(found)


@F.pandas_udf(_SPANS)
def find_spans(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Every place of every value in the text, as whole words or else anywhere: half-open code points from 0, in order."""
    for text, values in it:
        yield pd.Series([[{"start": s, "end": e, "value": v} for s, e, v in _spans_of(t, vs)] for t, vs in zip(text, values)])


@F.pandas_udf(_CHANGE)
def changed_span(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Where two texts differ: after their common start, before their common end."""
    out = []
    for a, b in zip(old.fillna(""), new.fillna("")):
        n, s = min(len(a), len(b)), 0
        while s < n and a[s] == b[s]:
            s += 1
        e = 0
        while e < n - s and a[-1 - e] == b[-1 - e]:
            e += 1
        out.append((s, len(a) - e, len(b) - e))
    return pd.DataFrame(out, columns=["start", "old_end", "new_end"])


def span_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def rewritten(text: Column, start: Column, end: Column, new: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), new, F.substring(text, end + 1, F.char_length(text)))


def fits_type(kind: Column, value: Column) -> Column:
    return F.when(kind == "numeric", value.rlike(r"^[0-9.,]+$")).when(kind == "date", value.rlike(r"[0-9]{4}")).when(kind == "name", ~value.rlike(r"^[0-9.,]+$")).otherwise(F.lit(True))


def errors(text: Column, start: Column, end: Column, old: Column, new: Column, kind: Column) -> Column:
    """What is wrong with a proposal; it is valid where this is empty."""
    bad = lambda c, name: F.when(~F.coalesce(c, F.lit(False)), F.lit(name))
    return F.array_compact(
        F.array(
            bad((start >= 0) & (start < end) & (end <= F.char_length(text)), "bounds"),
            bad(span_text(text, start, end) == old, "literal"),
            bad(T.whole_count(text, old) == 1, "unique"),
            bad(fits_type(kind, new), "type"),
            bad((F.trim(new) != "") & (new != old), "value"),
        )
    )


def apply_proposals(rows: DataFrame) -> DataFrame:
    """new_passage of valid proposals and the errors of all; rows: passage, start, end, old, new, kind."""
    c = {k: F.col(k) for k in ("passage", "start", "end", "old", "new", "kind")}
    out = rows.withColumn("errors", errors(c["passage"], c["start"], c["end"], c["old"], c["new"], c["kind"]))
    return out.withColumn("new_passage", F.when(F.size("errors") == 0, rewritten(c["passage"], c["start"], c["end"], c["new"])))


def ledger(applied: DataFrame) -> DataFrame:
    """Failures by their first reason, most frequent first; a failure is a row, never an exception."""
    return applied.where(F.size("errors") > 0).groupBy(F.element_at("errors", 1).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def edited_paragraphs(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """Passages with their edited text where one of the question's edits has exactly this text. edits: question_id, old_passage, new_passage."""
    new = edits.select("question_id", F.xxhash64("old_passage").alias("h"), F.col("old_passage").alias("text"), "new_passage")
    return paragraphs.withColumn("h", F.xxhash64("text")).join(new, ["question_id", "h", "text"], "left").withColumn("text", F.coalesce("new_passage", "text")).drop("h", "new_passage")


def bridge_synced(sentences: Column, new_key: Column) -> Column:
    """Some gold sentence holds the new key after normalisation."""
    key = T.normalize_answer(new_key)
    return F.exists(sentences, lambda s: F.contains(T.normalize_answer(s), key))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(s1, s2) < F.least(e1, e2)
