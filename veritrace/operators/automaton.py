"""Many patterns at once: which of them occur in each text, by an Aho-Corasick automaton over blocks of patterns.

Every text is read once for each block of at most BLOCK_BYTES of patterns, whatever their number in it; only one
block at a time is held by the driver and by a task, so nothing grows with the table of patterns but the number of passes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns in a block.
BLOCK_BYTES = 4 << 20


def occurring(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """texts with `found`, the sorted distinct patterns that occur anywhere in the text, letter by letter. Empty and null patterns occur nowhere.

    A row whose patterns lie in several blocks gets one row for each block; rows without any pattern go."""
    known = patterns.select(F.col(pattern).alias("pattern")).where(F.col("pattern") != "").distinct()
    size = known.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in texts.dtypes), "found array<string>"])
    at, out = texts.columns.index(text), None
    context = texts.sparkSession.sparkContext
    for k in range(blocks):
        own = known.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        held = context.broadcast([r["pattern"] for r in own.collect()])  # about block_bytes
        part = texts.mapInArrow(_finder(held, at), schema)
        out = part if out is None else out.unionByName(part)
    return texts.where("false").withColumn("found", F.array().cast("array<string>")) if out is None else out


def _finder(held, at: int):
    def find(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in held.value:
            machine.add_word(p, p)
        if held.value:
            machine.make_automaton()
        for batch in batches:
            found = [sorted({p for _, p in machine.iter(t)}) if t and held.value else [] for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array(found, pa.list_(pa.string()))]
            whole = pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "found"])
            yield whole.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return find
