"""Draws with replacement that SQL can follow: slot j draws the number hash(prefix, j) mod n, slots 1 to n.

The hash is the first eight hex digits of md5(prefix || j). Slots are cut into chunks that tasks draw by themselves; md5 runs over
whole arrays of slots, as nothing but j changes from one to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

#: Slots that are drawn at once, slots of a row of chunked(), and slots of a task.
_AT_ONCE, SLOTS, TASK_SLOTS = 1 << 16, 1 << 20, 1 << 25

_K = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def _compressed(state: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    """One block of md5 for arrays of states and words; words that all slots share are arrays of one number. Steps reuse their arrays."""
    a, b, c, d = (x.copy() for x in state)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += words[_WORDS[i]] + _K[i]
        f += a
        s = _SHIFTS[i]
        np.left_shift(f, np.uint32(s), out=turned)
        f >>= np.uint32(32 - s)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d))]


def heads(prefix: bytes, lo: int, hi: int) -> np.ndarray:
    """The first eight hex digits, as a number, of md5(prefix || j) for lo <= j < hi."""
    return _heads([prefix], lo, hi)[0]


def _heads(prefixes: list[bytes], lo: int, hi: int) -> np.ndarray:
    """heads() of prefixes of one length, a row for each."""
    known = np.frombuffer(b"".join(prefixes), np.uint8).reshape(len(prefixes), -1)
    step, out = max(1, _AT_ONCE // len(prefixes)), []
    while lo < hi:
        digits = len(str(lo))
        end = min(hi, 10**digits, lo + step)
        j, size = np.arange(lo, end), known.shape[1] + digits
        blocks = (size + 8) // 64 + 1
        message = np.zeros((len(prefixes), blocks * 64), np.uint8)
        message[:, : known.shape[1]] = known
        message[:, size] = 0x80
        message[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
        packed = message.view("<u4").astype(np.uint32)
        words = [packed[:1, k : k + 1] if (packed[:, k] == packed[0, k]).all() else packed[:, k : k + 1] for k in range(16 * blocks)]
        for k in range(digits):
            at = known.shape[1] + k
            digit = (j // 10 ** (digits - 1 - k) % 10 + 0x30).astype(np.uint32)
            words[at // 4] = words[at // 4] | digit << np.uint32(8 * (at % 4))
        state = [np.full((len(prefixes), end - lo), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        for k in range(blocks):
            state = _compressed(state, words[16 * k : 16 * k + 16])
        out.append(state[0].byteswap())
        lo = end
    return np.concatenate(out, axis=1) if out else np.zeros((len(prefixes), 0), np.uint32)


def _drawn(rows: list[dict], n: str) -> Iterator[tuple[int, np.ndarray]]:
    """The place of each row and the numbers that it draws; rows of few slots are drawn together, as many as fill _AT_ONCE."""
    alike: dict[tuple, list[tuple[int, bytes]]] = {}
    for k, row in enumerate(rows):
        prefix = row["prefix"].encode()
        alike.setdefault((len(prefix), row["lo"], row["hi"], row[n]), []).append((k, prefix))
    for (_, lo, hi, m), same in alike.items():
        at_once = max(1, _AT_ONCE // (hi - lo))
        for x in range(0, len(same), at_once):
            part = same[x : x + at_once]
            yield from zip([k for k, _ in part], _heads([p for _, p in part], lo, hi) % m)


def chunked(spaces: DataFrame, b: int, n: str, prefix: Column) -> DataFrame:
    """The columns of spaces with r, prefix, lo and hi: the slots [lo, hi) of each of b replicates, at most SLOTS in a row, dealt over tasks.

    spaces: few rows; n: its column of slots; prefix may use r."""
    spark = spaces.sparkSession
    rows = spaces.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn("lo", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n), F.lit(SLOTS).cast("long"))))
    rows = rows.withColumns({"prefix": prefix, "hi": F.least(F.col("lo") + SLOTS, F.col(n) + 1)})
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def pattern_counts(slots: DataFrame, ends: str, n: str) -> DataFrame:
    """chunked() rows with times: how often each pattern was drawn, where pattern k holds the numbers from ends[k - 1] up to ends[k]."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([ends, n, "prefix", "lo", "hi"]).to_pylist()
            times: list = [None] * len(rows)
            for k, i in _drawn(rows, n):
                own = np.array(rows[k][ends])
                if own[-1] <= 4 * len(i):  # counting numbers costs less than seeking their patterns
                    times[k] = np.add.reduceat(np.bincount(i, minlength=own[-1]), [0, *own[:-1]]).tolist()
                else:
                    times[k] = np.bincount(np.searchsorted(own, i, "right"), minlength=len(own)).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(times, pa.list_(pa.int64()))], [*batch.schema.names, "times"])

    return slots.mapInArrow(drawn, Ty.StructType([*slots.schema, Ty.StructField("times", Ty.ArrayType(Ty.LongType()))]))


def places_by_block(slots: DataFrame, n: str, block: int) -> DataFrame:
    """space, block, r, at: the numbers drawn, each as its 16-bit place in its block of `block` numbers."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["space", "r", n, "prefix", "lo", "hi"]).to_pylist()
            for k, i in _drawn(rows, n):
                row, own = rows[k], i // block
                order = np.argsort(own.astype(np.uint16) if row[n] < block << 16 else own, kind="stable")
                own, at = own[order], (i % block).astype(np.uint16)[order]
                cuts = np.flatnonzero(np.diff(own, prepend=-1))
                data = [at[x:y].tobytes() for x, y in zip(cuts, [*cuts[1:], len(at)])]
                head = [pa.array([row["space"]] * len(cuts), pa.string()), pa.array(own[cuts], pa.int64()), pa.array([row["r"]] * len(cuts), pa.int32())]
                yield pa.RecordBatch.from_arrays([*head, pa.array(data, pa.binary())], ["space", "block", "r", "at"])

    return slots.mapInArrow(drawn, "space string, block long, r int, at binary")
