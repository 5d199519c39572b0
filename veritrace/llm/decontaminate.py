"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of `window` words (a shorter item is one window). For exact
containment a window and a document's stretch of the same length share every shingle, so
one necessary prefix shingle per window suffices: the rarest by its count over all
documents. Documents are probed for these shingles alone; the offset of the shingle gives
the only place where the window can lie (positional bound), which must fit inside the
document (length bound); then the words themselves are compared.

The benchmark is worked through in blocks of at most BLOCK_BYTES bytes of its texts. A block's
windows are flat arrays of 64-bit hashes of words and of places in them, about fifteen bytes
for each byte of text; one block's index is held at a time, by the driver and by each task.

Odd inputs. Null texts have no words; rows of the benchmark without an id or words are never
found. Repeated item ids count once, and an item id that has two texts has the windows of
both. Repeated document rows each get a row. Very long texts are read in segments. Of shingles
with the same count the one with the lesser hash is the window's key. An empty benchmark hits
nothing, empty documents give no rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, PUNCT, Known, buffers, discarded, distinct, lean, mixed, rolled, slices, word_spans, written

#: Words of a prefix shingle.
SHINGLE = 2
#: Benchmark bytes held at once by driver and executors; more are worked through in blocks.
BLOCK_BYTES = 8 << 20
#: Counts of a slice of shingles, which are summed and sent to the driver as one value.
SLICE = 1 << 16


class Windows:
    """Distinct windows of a block of items: places in the block's words. Windows are told apart by 64-bit hashes of 64-bit hashes of words."""

    def __init__(self, items: list[tuple], window: int):
        items = [(n, t) for n, t in items if n is not None]
        data, off = buffers(pa.array([t for _, t in items], pa.string()))
        self.start, self.end, self.h, first = word_spans(data, off, PUNCT, LOWER)
        self.low = LOWER[data] if len(data) else data
        words = np.diff(first) if len(items) else np.zeros(0, np.int64)
        n = np.minimum(words, window)
        count = np.where(n > 0, words - n + 1, 0)
        item, size = np.repeat(np.arange(len(items)), count), np.repeat(n, count)
        at = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        key = np.zeros(len(at), np.uint64)
        for k in np.unique(size).tolist():
            own = size == k
            key[own] = mixed(rolled(self.h, k)[at[own]] + np.uint64(k))
        _, firsts, number = np.unique(key, return_index=True, return_inverse=True)
        #: of each window its first word and its number of words
        self.at, self.size = at[firsts], size[firsts]
        names = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(names)}
        pair = distinct(number.astype(np.int64) * max(1, len(names)) + np.array([place[name] for name, _ in items], np.int64)[item]) if len(at) else np.zeros(0, np.int64)
        #: the items of window w are names[k] for k in item[item_off[w] : item_off[w + 1]]
        self.names, self.item = names, pair % max(1, len(names))
        self.item_off = np.searchsorted(pair // max(1, len(names)), np.arange(len(firsts) + 1))

    def shingle_size(self) -> np.ndarray:
        return np.minimum(self.size, SHINGLE)


def shingle_counts(docs: DataFrame, known: np.ndarray, size: int) -> np.ndarray:
    """How often each shingle of `known` (sorted, of `size` words) occurs in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(Known(known))

    @lean
    def count(batches):
        total = np.zeros(len(known), np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                r = rolled(word_spans(*buffers(b.column(0)), PUNCT, LOWER)[2], size)
                total += np.bincount(np.searchsorted(held.value.known, r[held.value.positions(r)]), minlength=len(total))
        parts = [(k, total[k * SLICE : (k + 1) * SLICE]) for k in range(-(-len(total) // SLICE))]
        parts = [(k, x.tobytes()) for k, x in parts if x.any()]
        if parts:
            yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in parts], pa.int64()), "n": pa.array([x for _, x in parts], pa.binary())})

    @lean
    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("n"))
        return pa.table({"k": t.column("k")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(len(known), np.int64)
    for r in docs.select("text").mapInArrow(count, "k long, n binary").groupBy("k").applyInArrow(add, "k long, n binary").collect():
        part = np.frombuffer(bytes(r["n"]), np.int64)
        out[r["k"] * SLICE : r["k"] * SLICE + len(part)] = part
    return out


class Index:
    """Prefix shingle -> windows, for the probe."""

    def __init__(self, windows: Windows, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """counts: by shingle size, the sorted shingles and their occurrences over all documents."""
        self.windows = w = windows
        #: by shingle size: the keys, and the windows of key k with their keys' offsets in them, from first[k] to first[k + 1]
        self.keys: dict[int, tuple[Known, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, (known, occurs) in counts.items():
            own = np.flatnonzero(w.shingle_size() == size)
            r = rolled(w.h, size)
            seen = occurs[np.minimum(np.searchsorted(known, r), len(known) - 1)]
            best, offset = w.at[own].copy(), np.zeros(len(own), np.int64)
            for k in range(1, int(w.size[own].max()) - size + 1):
                at = np.minimum(w.at[own] + k, len(r) - 1)
                better = (k <= w.size[own] - size) & ((seen[at] < seen[best]) | (seen[at] == seen[best]) & (r[at] < r[best]))
                best[better], offset[better] = at[better], k
            found = seen[best] > 0  # else the window is nowhere
            key, own, offset = r[best[found]], own[found], offset[found]
            order = np.argsort(key, kind="stable")
            key = key[order]
            if len(key):
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                self.keys[size] = Known(key[first]), np.r_[first, len(key)], own[order], offset[order]


def _probe(index: Index, data, off):
    """Each text's first word, and for texts with a hit: positions of hit words and found item ids."""
    start, end, h, first = word_spans(data, off, PUNCT, LOWER)
    hits: dict[int, tuple[set, set]] = {}
    w = index.windows
    for size, (known, posting, window, offset) in index.keys.items():
        r = rolled(h, size)
        at = known.positions(r)
        key = np.searchsorted(known.known, r[at])
        for p, k, d in zip(at.tolist(), key.tolist(), (np.searchsorted(first, at, "right") - 1).tolist()):
            a, b = int(first[d]), int(first[d + 1])
            for i in range(posting[k], posting[k + 1]):
                x = int(window[i])
                q, n, own = p - int(offset[i]), int(w.size[x]), int(w.at[x])
                if q < a or q + n > b:  # positional and length bound
                    continue
                if np.array_equal(h[q : q + n], w.h[own : own + n]) and all(np.array_equal(LOWER[data[start[q + j] : end[q + j]]], w.low[w.start[own + j] : w.end[own + j]]) for j in range(n)):
                    got = hits.setdefault(d, (set(), set()))
                    got[0].update(range(q - a, q - a + n))
                    got[1].update(w.names[j] for j in w.item[w.item_off[x] : w.item_off[x + 1]])
    return first, hits


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The blocks' items, one after the other, and the number of blocks."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    n = max(1, -(-(total["n"] + 64 * total["rows"]) // block_bytes))

    def items():
        for k in range(n):
            part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            yield [(None if r["item_id"] is None else str(r["item_id"]), r["text"]) for r in part.select("item_id", "text").collect()]

    return items(), n


def _indexed(docs: DataFrame, items: list[tuple], window: int) -> Index:
    windows, counts = Windows(items, window), {}
    for size in np.unique(windows.shingle_size()).tolist():
        own = windows.shingle_size() == size
        r, at, n = rolled(windows.h, size), windows.at[own], windows.size[own] - size + 1
        known = distinct(r[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        counts[size] = known, shingle_counts(docs, known, size)
    return Index(windows, counts)


_FOUND = "doc_id long, n_words long, hits array<int>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, positions of hit words (from 0) and the item ids found, both sorted."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # in several blocks each writes the hits that it finds, so that its index can go; rows meet by the document's content and id
    keyed = read.withColumn("row", F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256))
    found = []
    blocks, n = _blocks(benchmark, block_bytes)
    for items in blocks:
        index = _indexed(docs, items, window)

        @lean
        def probe(batches, index=index, every=not found):
            for whole in batches:
                for b in slices(whole, "text"):
                    first, hits = _probe(index, *buffers(b.column(1)))
                    rows = np.arange(b.num_rows) if every else np.array(sorted(hits), np.int64)
                    columns = [b.column(0).take(pa.array(rows)), pa.array(np.diff(first)[rows] if b.num_rows else [], pa.int64())]
                    columns += [pa.array([sorted(hits[k][x]) if k in hits else [] for k in rows.tolist()], pa.list_(kind)) for x, kind in ((0, pa.int32()), (1, pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns + [b.column(k).take(pa.array(rows)) for k in range(2, b.num_columns)], ["doc_id", "n_words", "hits", "items", *b.schema.names[2:]])

        if n == 1:
            return read.mapInArrow(probe, _FOUND)
        found.append(written(keyed.mapInArrow(probe, _FOUND + ", row string").withColumn("first", F.lit(not found)), "contamination-block"))
    merged = found[0]
    for part in found[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.sum(F.col("first").cast("int")).alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return merged.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("c"), "doc_id", "n_words", "hits", "items").drop("c")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_share: float = 0.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of docs whose hit words make up at most this share of their words; docs' columns."""
    left, before, at = docs, None, docs.columns.index("text")
    blocks, n = _blocks(benchmark, block_bytes)
    for items in blocks:
        index = _indexed(left, items, window)

        @lean
        def keep(batches, index=index, at=at):
            for whole in batches:
                for b in slices(whole, "text"):
                    first, hits = _probe(index, *buffers(b.column(at)))
                    n = np.diff(first)
                    ok = np.ones(b.num_rows, bool)
                    for k, (words, _) in hits.items():
                        ok[k] = len(words) <= most_share * n[k]
                    yield b.filter(pa.array(ok))

        left = left.mapInArrow(keep, docs.schema)
        if n > 1:  # so that one block's index is held at a time
            left = written(left, "contamination-left")
            if before is not None:
                discarded(before)
            before = left
    return left


def brute_force(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """The same result by comparing all windows with all stretches; for tests."""
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
    windows: dict[tuple, set] = {}
    for name, text in items:
        w = split(text)
        n = min(window, len(w))
        if n and name is not None:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id::VARCHAR AS item, n, array_to_string(w[p:p + n - 1], ' ') AS v
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS v FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, item, p, n FROM dw JOIN bw USING (n, v)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""
