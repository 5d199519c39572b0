"""Shared parts of the training-data operators: tables, shared storage and word scanning."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

_FALLBACK_DIR: list[str] = []


#: Rows and bytes of an Arrow batch: texts are long, and a batch is held by the JVM and by its worker at once.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    lean_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, unless the session has bounds of its own."""
    for key, default, own in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, own)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where one machine runs everything may it be unset; a folder of our own serves then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: executors and driver need a folder that all of them share")
    if not _FALLBACK_DIR:
        _FALLBACK_DIR.append("file://" + tempfile.mkdtemp(prefix="veritrace-"))
    return _FALLBACK_DIR[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, safe against lost executors."""
    ship(df.sparkSession)
    lean_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(df: DataFrame, bytes_each: int = 32 << 20, most: int = 1 << 20) -> int:
    """Partitions for a shuffle that grows with the input: the session's number, or more for a large scan."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(size // bytes_each, most)) if size < 1 << 60 else least  # Spark's word for an unknown size


def least_by_hash(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The `rows` rows with the least hash of the keys: a sample that depends on neither partitions nor order.

    A bound on the hash, from the number of rows, comes first, so that the sort that
    follows sees about as many rows as are wanted however large df is.
    """
    h = F.xxhash64(*keys)
    n = df.count()
    if n > 2 * rows + 1000:
        share = (rows + 6 * rows**0.5 + 50) / n
        df = df.where(h < int(share * 2.0**64) - (1 << 63))
    return df.orderBy(h, *keys).limit(rows)


#: Bytes of a group after which memory is given back; after less it is not worth the call.
_LARGE = 1 << 20


def _give_back() -> None:
    """Returns memory that this process has freed to the system: a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def lean(f: Callable) -> Callable:
    """f for mapInArrow, or for one or two grouped tables, giving memory back when its task or group is done."""
    if inspect.isgeneratorfunction(f):

        def wrapped(batches):
            try:
                yield from f(batches)
            finally:
                _give_back()

    elif len(inspect.signature(f).parameters) == 1:

        def wrapped(table):
            try:
                return f(table)
            finally:
                if table.nbytes > _LARGE:
                    _give_back()

    else:

        def wrapped(left, right):
            try:
                return f(left, right)
            finally:
                if left.nbytes + right.nbytes > _LARGE:
                    _give_back()

    return wrapped


# --- scanning of UTF-8 columns -------------------------------------------------------------

_BYTES = np.arange(256)
#: Separators of words `[^\x20\x09-\x0D]+`.
WHITE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: Separators of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; upper case counts after lower-casing.
PUNCT = (_BYTES < 0x80) & ~(((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A) & (_BYTES >= 0x41))
SAME = _BYTES.astype(np.uint8)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_SEGMENT = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


_RANDOM = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, _SEGMENT + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for base in (_BASE, inverse):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x, dtype=np.uint64))
        if len(_POWERS) > 2:
            del _POWERS[:2]
    return _POWERS[0], _POWERS[1]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: start, end, 64-bit hash of the lower-cased bytes, and each text's first word.

    The hash is a polynomial over random byte values, from prefix sums, so that no word
    is touched by Python. Segments end at a text's end or a separator: memory is bounded
    by the longest word, not by the longest text.
    """
    table_ = _RANDOM[lower]
    starts, ends, hashes = [], [], []
    pos, stop = int(off[0]), int(off[-1])
    while pos < stop:
        end = min(pos + _SEGMENT, stop)
        if end < stop:
            edge = int(off[np.searchsorted(off, end, "right") - 1])
            if edge > pos:
                end = edge
            else:
                text_end = int(off[np.searchsorted(off, end, "right")])
                cut = np.flatnonzero(sep[data[pos:end]])
                while not len(cut) and end < text_end:
                    at, end = end, min(end + _SEGMENT, text_end)
                    cut = np.flatnonzero(sep[data[at:end]]) + (at - pos)
                end = pos + int(cut[-1]) + 1 if len(cut) else text_end
        seg = data[pos:end]
        word = ~sep[seg]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = off[np.searchsorted(off, pos, "right") : np.searchsorted(off, end, "left")] - pos
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _powers(len(seg) + 1)
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(table_[seg] * power[: len(seg)], out=total[1:])
        h = (total[e] - total[s]) * inverse[s]
        starts.append(s + pos)
        ends.append(e + pos)
        hashes.append(mixed(h + (e - s).astype(np.uint64) * _ODD))
        pos = end
    if not starts:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, off)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct entries; by a sort, which is much quicker here than numpy's unique by hashing."""
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate([[True], x[1:] != x[:-1]])]


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of h."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _ODD + h[k : len(h) - n + 1 + k]
    return mixed(out)


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20, least_rows: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text; a longer text is a part of its own."""
    _, off = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(off, off[at] + most, "right")) - 1
        end = min(max(end, at + least_rows), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


class Known:
    """A sorted array of 64-bit hashes that can be looked up quickly: a table of flags by their first bits comes before the search."""

    BITS = 20

    def __init__(self, known: np.ndarray):
        self.known = known
        self.flags = np.zeros(1 << self.BITS, bool)
        self.flags[self._first(known)] = True

    @classmethod
    def _first(cls, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - cls.BITS)).astype(np.int64)

    def positions(self, h: np.ndarray) -> np.ndarray:
        """Of the entries of h that are known."""
        at = np.flatnonzero(self.flags[self._first(h)])
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        return at[self.known[k] == h[at]]

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        out[self.positions(h)] = True
        return out


def id_bitmap(ids: np.ndarray, bits: int) -> np.ndarray:
    """A Bloom filter of two probes over int64 ids in 2**bits bits."""
    out = np.zeros(1 << max(bits - 3, 0), np.uint8)
    for probe in _probes(ids, bits):
        np.bitwise_or.at(out, probe >> 3, (1 << (probe & 7)).astype(np.uint8))
    return out


def in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bits = int(len(bitmap)).bit_length() + 2
    found = np.ones(len(ids), bool)
    for probe in _probes(ids, bits):
        found &= (bitmap[probe >> 3] >> (probe & 7).astype(np.uint8)) & 1 == 1
    return found


def _probes(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = mixed(np.asarray(ids, np.int64).view(np.uint64) + _ODD)
    for part in (h >> np.uint64(64 - bits), (h << np.uint64(31)) >> np.uint64(64 - bits)):
        yield part.astype(np.int64)


def bloom(ids: DataFrame, bits: int = 25) -> np.ndarray:
    """Bitmap of a one-column int64 DataFrame, made on the executors; its size is fixed by `bits`
    (4 MB at 25), whatever the number of ids: with more ids more rows pass, and an exact join must follow."""
    column = ids.columns[0]

    def partial(batches):
        out = None
        for b in batches:
            values = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(values):
                own = id_bitmap(values, bits)
                out = own if out is None else out | own
        if out is not None:
            size = max(1, len(out) >> 4)
            for k in range(0, len(out), size):
                part = out[k : k + size]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "bits": pa.array([part.tobytes()], pa.binary())})

    def merge(key, rows):
        out = None
        for b in rows:
            for x in b.column("bits").to_pylist():
                x = np.frombuffer(x, np.uint8)
                out = x if out is None else out | x
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    parts = ids.select(F.col(column).cast("long")).mapInArrow(partial, "k long, bits binary").groupBy("k").applyInArrow(lambda key, t: merge(key, t.to_batches()), "k long, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.collect():
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[row["k"] : row["k"] + len(part)] = part
    return out
