"""Reversible removal of lines that many documents share: an index of line keys that takes documents in and out.

A line's key is a digest of the line, stripped and with A-Z lower-cased; keys shorter than LEAST characters are never
looked at. The index holds exact tables, `refs` (a row for each key and document, with later withdrawals) and
`counts` (documents of a key and the largest of them), and a cuckoo filter for each shard of keys. A filter
has just the keys that at least MANY documents hold: a key is put in when its count gets there and
deleted when it falls below. Cleaning asks the filters first, so lines that few documents share never meet the
exact tables; what the filters let through is looked up in `counts`, which makes the answer exact.

Documents are told by doc_id: rows of one doc_id are one document, whose line keys are those of all its rows; a null
doc_id is a document that is smaller than all others. A null or empty text is one empty line. Very long texts
are taken whole, as are very long lines. Columns besides doc_id and text are ignored, whatever their names. Empty
tables give empty ones. Putting in documents that are there, or taking out ones that are not, changes nothing.
"""

from __future__ import annotations

import hashlib
import inspect
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mixed, written

#: Characters of a key that counts, and documents that must hold it.
LEAST, MANY = 20, 3
_WHITE = " \t\n\x0b\x0c\r"
#: Keys that a shard's filter has at most when it is made; shards are added when there are four times as many.
SHARD_KEYS = 50_000
#: Pairs of key and document that ask one copy of a filter.
_ASKING = 500_000


def key_of(line: str) -> bytes | None:
    line = line.strip(_WHITE)
    return hashlib.md5(line.encode().lower()).digest() if len(line) >= LEAST else None


def line_keys(docs: DataFrame) -> DataFrame:
    """key, doc_id: a row for each distinct key of each row."""

    def keys(batches):
        for batch in batches:
            found, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = {key_of(line) for line in text.split("\n")} if text else set()
                own.discard(None)
                found += own
                rows += [k] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(keys), "key binary, doc_id long")


def keyed_lean(f):
    """f(key, table) or f(key, left, right), giving memory back as lean() does."""
    if len(inspect.signature(f).parameters) == 2:
        return lambda key, rows: lean(lambda t: f(key, t))(rows)
    return lambda key, left, right: lean(lambda x, y: f(key, x, y))(left, right)


# --- cuckoo filters


class Cuckoo:
    """16-bit fingerprints in buckets of four, two buckets for each key; what finds no place goes to a stash. Keys are 64-bit hashes."""

    WAYS, FULL, ROUNDS = 4, 0.85, 200

    def __init__(self, slots: np.ndarray, stash: Counter):
        self.slots, self.stash = slots, stash
        self.mask = np.int64(len(slots) - 1)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (cls.FULL * cls.WAYS)))))
        return cls(np.zeros((buckets, cls.WAYS), np.uint16), Counter())

    @classmethod
    def read(cls, slots: bytes, stash: list[int]) -> Cuckoo:
        return cls(np.frombuffer(slots, np.uint16).reshape(-1, cls.WAYS).copy(), Counter(stash))

    @property
    def capacity(self) -> int:
        return int(self.slots.size * self.FULL)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ ((mixed(print_.astype(np.uint64)) >> np.uint64(7)).astype(np.int64) & self.mask)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        print_ = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (h & np.uint64(self.mask)).astype(np.int64)
        return print_, one, self._other(one, print_)

    @staticmethod
    def _code(one: np.ndarray, two: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return np.minimum(one, two) << 16 | print_.astype(np.int64)

    def _put(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        """Puts what has room in its bucket; which of them had none."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        taken = self.slots[b] != 0
        fits = rank < self.WAYS - taken.sum(1)
        free = np.argsort(taken[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
        self.slots[b[fits], free] = print_[order][fits]
        return order[~fits]

    def insert(self, h: np.ndarray) -> None:
        """Each key once; one that is in already gets a second place."""
        if not len(h):
            return
        print_, bucket, other = self._places(h)
        left = self._put(bucket, print_)
        print_, bucket = print_[left], other[left]
        for k in range(self.ROUNDS):
            if not len(bucket):
                return
            left = self._put(bucket, print_)
            print_, bucket = print_[left], bucket[left]
            if not len(bucket):
                return
            _, one = np.unique(bucket, return_index=True)  # one newcomer of each bucket takes the place of an older print
            way = (k + bucket[one]) % self.WAYS
            print_[one], self.slots[bucket[one], way] = self.slots[bucket[one], way], print_[one]
            bucket = self._other(bucket, print_)
        self.stash.update(self._code(bucket, self._other(bucket, print_), print_).tolist())

    def has(self, h: np.ndarray) -> np.ndarray:
        print_, one, two = self._places(h)
        found = (self.slots[one] == print_[:, None]).any(1) | (self.slots[two] == print_[:, None]).any(1)
        if self.stash:
            found |= np.isin(self._code(one, two, print_), np.array([*self.stash]))
        return found

    def delete(self, h: np.ndarray) -> None:
        """Takes one print of each key out; the keys must be in."""
        while len(h):
            print_, one, two = self._places(h)
            _, now = np.unique(self._code(one, two, print_), return_index=True)  # keys of one print and buckets go one at a time
            p, gone = print_[now], np.zeros(len(now), bool)
            for bucket in (one[now], two[now]):
                hit = (self.slots[bucket] == p[:, None]) & ~gone[:, None]
                any_ = hit.any(1)
                self.slots[bucket[any_], hit.argmax(1)[any_]] = 0
                gone |= any_
            self.stash.subtract(self._code(one[now], two[now], p)[~gone].tolist())
            self.stash = +self.stash
            h = np.delete(h, now)

    def row(self, shard: int, keys: int, full: bool = False) -> pa.Table:
        stash = pa.array([list(self.stash.elements())], pa.list_(pa.int64()))
        return pa.table({"shard": pa.array([shard], pa.int64()), "slots": pa.array([self.slots.tobytes()], pa.binary()), "stash": stash, "keys": pa.array([keys], pa.int64()), "full": pa.array([full])})


_FILTER = "shard long, slots binary, stash array<long>, keys long, full boolean"


def _hashes(keys: pa.ChunkedArray) -> np.ndarray:
    """First eight bytes of 16-byte keys."""
    return np.frombuffer(b"".join(keys.to_pylist()), ">u8")[::2].astype(np.uint64)


def _shard(shards: int):
    """By the last bytes of a key; filters use the first."""
    return (F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long") % shards).alias("shard")


def _made(key, keys: pa.Table) -> pa.Table:
    h = _hashes(keys.column("key"))
    out = Cuckoo.sized(len(h))
    out.insert(h)
    return out.row(key[0].as_py(), len(h))


def _changed(key, filters: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filter after its changes; marked as full, and not to be used, where they do not fit."""
    add = changes.column("add").to_numpy()
    h = _hashes(changes.column("key"))
    if not filters.num_rows:
        out, keys = Cuckoo.sized(int(add.sum())), 0
    else:
        row = filters.to_pylist()[0]
        out, keys = Cuckoo.read(row["slots"], row["stash"]), row["keys"]
    keys += int(add.sum() - (~add).sum())
    full = keys > out.capacity
    if not full:
        out.delete(h[~add])
        out.insert(h[add])
    return out.row(key[0].as_py(), keys, full)


# --- the index


@dataclass(frozen=True)
class LineIndex:
    """A state of the index; putting documents in or taking them out gives another one and leaves this as it is."""

    refs: DataFrame | None = None
    counts: DataFrame | None = None
    filters: DataFrame | None = None
    shards: int = 0

    def held(self) -> DataFrame:
        """key, doc_id of all documents that are in."""
        return self.refs.groupBy("key", "doc_id").agg(F.sum("change").alias("change")).where("change > 0").drop("change")

    def inserted(self, docs: DataFrame) -> LineIndex:
        pairs = line_keys(docs).distinct()
        if self.refs is not None:
            again = self.held().join(docs.select(F.col("doc_id").cast("long").alias("own")).distinct(), F.col("doc_id").eqNullSafe(F.col("own")), "left_semi")
            pairs = pairs.alias("p").join(again.alias("a"), (F.col("p.key") == F.col("a.key")) & F.col("p.doc_id").eqNullSafe(F.col("a.doc_id")), "left_anti")
        refs = written(pairs.withColumn("change", F.lit(1)), "lines-refs")
        delta = refs.groupBy("key").agg(F.count("*").alias("more"), F.max("doc_id").alias("top"))
        if self.counts is None:
            counts = delta.select("key", F.col("more").alias("n_docs"), F.col("top").alias("last_doc"), F.lit(0).cast("long").alias("was"))
        else:
            n = F.coalesce("n_docs", F.lit(0)).cast("long")
            counts = self.counts.drop("was").join(delta, "key", "full").select("key", (n + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "top").alias("last_doc"), n.alias("was"))
        return self._with(refs if self.refs is None else self.refs.unionByName(refs), written(counts, "lines-counts"))

    def deleted(self, ids: DataFrame) -> LineIndex:
        """Without the documents of these doc_ids."""
        own = ids.select(F.col("doc_id").cast("long").alias("own")).distinct()
        gone = written(self.held().join(own, F.col("doc_id").eqNullSafe(F.col("own")), "left_semi").withColumn("change", F.lit(-1)), "lines-refs")
        refs = self.refs.unionByName(gone)
        delta = gone.groupBy("key").agg(F.count("*").alias("less"), F.max(F.struct("doc_id"))["doc_id"].alias("top"))
        kept = self.counts.drop("was").join(delta, "key", "left").select("key", F.col("n_docs").alias("was"), (F.col("n_docs") - F.coalesce("less", F.lit(0))).alias("n_docs"), "last_doc", (F.col("less").isNotNull() & F.col("top").eqNullSafe(F.col("last_doc"))).alias("headless"))
        kept = written(kept, "lines-kept")
        # only keys whose largest document went look for the next one among the exact references
        headless = kept.where("headless AND n_docs > 0").select("key")
        tops = LineIndex(refs).held().join(headless, "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("next"))
        last = F.when(F.col("headless"), F.col("next")).otherwise(F.col("last_doc"))
        counts = written(kept.join(tops, "key", "left").select("key", "n_docs", last.alias("last_doc"), "was"), "lines-counts")
        return self._with(refs, counts)

    def _with(self, refs: DataFrame, counts: DataFrame) -> LineIndex:
        """counts, with what each was before, brings the filters up to date; keys that no document holds any more go."""
        many = counts.where(F.col("n_docs") >= MANY)
        keys = many.count()
        live = counts.where("n_docs > 0")
        if self.filters is None or keys > 4 * SHARD_KEYS * self.shards:
            shards = max(16, 1 << max(0, int(np.ceil(np.log2(max(keys, 1) / SHARD_KEYS)))))
            return LineIndex(refs, live, written(many.select("key", _shard(shards)).groupBy("shard").applyInArrow(keyed_lean(_made), _FILTER), "lines-filters"), shards)
        changes = counts.where((F.col("was") < MANY) != (F.col("n_docs") < MANY)).select("key", (F.col("n_docs") >= MANY).alias("add"), _shard(self.shards))
        after = written(self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(keyed_lean(_changed_or_same), _FILTER), "lines-filters")
        full = after.where("full").select("shard")
        if full.isEmpty():
            return LineIndex(refs, live, after, self.shards)
        again = many.select("key", _shard(self.shards)).join(full, "shard", "left_semi").groupBy("shard").applyInArrow(keyed_lean(_made), _FILTER)
        return LineIndex(refs, live, written(after.where("NOT full").unionByName(again), "lines-filters"), self.shards)

    def shared(self, pairs: DataFrame) -> DataFrame:
        """The (key, doc_id) that a document loses: its key is one of MANY documents, and it is not the largest."""
        asked = pairs.select("key", "doc_id", _shard(self.shards))
        copies = asked.groupBy("shard").agg((F.floor(F.count("*") / _ASKING) + 1).alias("copies"))
        copies = written(copies, "lines-copies")
        asked = asked.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id"), "copies"))
        filters = self.filters.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        maybe = asked.select("shard", "copy", "key", "doc_id").groupBy("shard", "copy").cogroup(filters.groupBy("shard", "copy")).applyInArrow(lean(_maybe), "key binary, doc_id long")
        many = self.counts.where(F.col("n_docs") >= MANY).select("key", "last_doc")
        return maybe.join(many, "key").where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).select("key", "doc_id")

    def cleaned(self, docs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """doc_id, text without the lines that go, n_lines, n_dropped: a row for each row of docs. pairs: their line keys, where they are at hand."""
        losing = self.shared(line_keys(docs).distinct() if pairs is None else pairs).groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
        losing = losing.withColumnRenamed("doc_id", "own")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(losing, F.col("doc_id").eqNullSafe(F.col("own")), "left")
        return rows.select("doc_id", "text", "keys").mapInArrow(lean(_rewritten), "doc_id long, text string, n_lines long, n_dropped long")


def _changed_or_same(key, filters: pa.Table, changes: pa.Table) -> pa.Table:
    return _changed(key, filters, changes) if changes.num_rows else filters


def _maybe(pairs: pa.Table, filters: pa.Table) -> pa.Table:
    """Pairs that the shard's filter lets through."""
    pairs = pairs.select(["key", "doc_id"])
    if not pairs.num_rows or not filters.num_rows:
        return pairs.slice(0, 0)
    row = filters.to_pylist()[0]
    return pairs.filter(pa.array(Cuckoo.read(row["slots"], row["stash"]).has(_hashes(pairs.column("key")))))


def _rewritten(batches):
    for batch in batches:
        out, lines_, dropped = [], [], []
        for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lines = (text or "").split("\n")
            gone = set(keys or ())
            kept = [line for line in lines if key_of(line) not in gone] if gone else lines
            out.append("\n".join(kept))
            lines_.append(len(lines))
            dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: documents put into an empty index, and cleaned by it."""
    index = LineIndex().inserted(docs)
    out = index.cleaned(docs, index.refs.select("key", "doc_id"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """Plain version over (doc_id, text): doc_id, n_lines, n_dropped, text."""
    holders: dict[bytes, set] = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if key_of(line):
                holders.setdefault(key_of(line), set()).add(i)
    least = lambda i: (i is not None, i or 0)
    last = {k: max(v, key=least) for k, v in holders.items() if len(v) >= MANY}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in last or last[key_of(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


_STRIPPED = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
ORACLE_SQL = f"""WITH r AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(lines, 1) AS j, unnest(lines) AS line FROM r),
k AS (SELECT *, translate({_STRIPPED}, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
many AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= {MANY}),
f AS (SELECT k.*, last_doc IS NOT NULL AND last_doc IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN many USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM f GROUP BY r"""
