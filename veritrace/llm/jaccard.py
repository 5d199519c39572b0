"""Exact n-gram Jaccard self-join of documents, and its components.

A text's set is its distinct shingles of five words (lower-cased A-Z); two texts link when
the Jaccard similarity of their sets is at least 0.75. Texts with one and the same set are
one class, so copies are never paired.

1. One pass over the texts makes the sets and deals all tokens (hashed shingles) of each
   class to buckets, packed. A bucket counts in how many classes each token is, and hands
   back the tokens that two classes or more have. Tokens of a large share of all texts are
   found before by a bounded summary of each slice; they stay with their class and are only
   counted, with partial sums, so that no bucket gets all classes of a hot token.
2. Tokens are ordered by that count. A class of n tokens shares ceil(0.75 n) of them with
   any partner, so one of its first n - ceil(0.75 n) + 1 tokens is shared, and two of its
   first n - ceil(0.75 n) + 2. Classes whose tokens of their own fill that prefix have no
   partner and go: few are left, with their shared tokens only, which hold all overlaps.
3. Tokens of at most FREQUENT classes are indexed singly; classes that meet in one are pairs,
   verified on the shared tokens.
4. Classes with a more frequent token in their prefix are hard: both texts of a link that
   step 3 misses are. Links found so far join them into components; a round of stars joins
   most of a group of near copies at a cost of its members. Then tokens are ordered by the
   number of components that have them, prefixes are extended by one token, and tokens of few
   components (see frequent_among) are indexed singly, more frequent ones as combinations
   of two.
   Classes that share keys are gathered in blocks of a fixed size, whose overlaps are
   counted exactly in place.

Components come from repeated star contraction in storage. Nothing that grows with the
documents is collected or broadcast: hot tokens number at most 2 / HOT_SHARE times the mean
size of a set.

Odd inputs. Null and empty texts have no tokens and link with nothing. Rows that share a
doc_id keep a row each; a null doc_id has a null component. Repeated texts are one class.
Very long texts are read in segments, and their set is held once. Ties in the order of
tokens are broken by the token. An empty table gives an empty one. Extra columns are not
read, whatever their names. Tokens are told apart by 64-bit hashes in a set and by 40 bits
and their bucket across sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, WHITE, Known, bloom, buffers, discarded, distinct, in_bitmap, lean, mixed, partitions_for, rolled, slices, word_spans, written

SHINGLE = 5
#: Classes that may share a token for it to be indexed singly.
FREQUENT = 2
#: Share of all texts from which a token is surely hot, and texts that a hot token has at least.
HOT_SHARE, HOT_LEAST = 1 / 64, 32
#: Rounds of stars among hard classes, and tokens that a class tries in each.
ROUNDS, TRIES = 1, 4
#: Classes of a block of a family of hard classes.
FAMILY_BLOCK = 256
#: Components that may share a token of hard classes for it to be indexed singly: a quarter of the hard classes, up to what a few blocks hold.
FREQUENT_HARD = 4 * FAMILY_BLOCK
#: Classes of a block in verification.
BLOCK = 64
#: Tokens that a bucket sorts at once.
PART = 1 << 19
_SALT = np.uint64(0xA0761D6478BD642F)


def token_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct tokens of each text."""
    _, _, h, first = word_spans(data, off, WHITE, LOWER)
    token, out = rolled(h, size), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= size:
            out.append(distinct(token[a : b - size + 1]))
        elif n:
            out.append(mixed(rolled(h[a:b], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each of some sets, none of which is empty."""
    n = np.array([len(s) for s in sets], np.uint64)
    token, first = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    one, two = (np.add.reduceat(mixed(x), first) for x in (token ^ _SALT, token + _SALT))
    return mixed(one + n).view(np.int64), mixed(two ^ n).view(np.int64)


def hot_tokens(docs: DataFrame, share: float = HOT_SHARE, least: int = HOT_LEAST) -> np.ndarray:
    """Sorted tokens that may be in `share` of all texts or more.

    A slice of texts reports what half that share of its own texts has. A token of `share`
    of all texts is reported with half of its count or more, and at most 2 / share tokens
    for each token of a mean set can reach that bound. Texts of fewer words than a shingle
    are sets of their own, whose token is never shared.
    """

    @lean
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", 2 << 20, least_rows=64):
                bound, cells, held, at = max(2, share / 2 * b.num_rows), np.zeros(1 << 18, np.int64), [], 0
                for part in slices(b, "text", 1 << 20):
                    _, _, h, first = word_spans(*buffers(part.column(0)), WHITE, LOWER)
                    n = np.maximum(np.diff(first) - SHINGLE + 1, 0)
                    start = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    token = rolled(h, SHINGLE)[start] if len(start) else start.astype(np.uint64)
                    held.append((token, np.repeat(np.arange(at, at + part.num_rows, dtype=np.int32), n)))
                    at += part.num_rows
                    cells += np.bincount((token >> np.uint64(46)).astype(np.int64), minlength=1 << 18)
                token, owner = (np.concatenate(x) for x in zip(*held))
                many = cells[(token >> np.uint64(46)).astype(np.int64)] >= bound
                token, owner = token[many], owner[many]
                order = np.lexsort((owner, token))
                token, owner = token[order], owner[order]
                new = np.ones(len(token), bool)
                new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
                token, n = np.unique(token[new], return_counts=True)
                token, n = token[n >= bound], n[n >= bound]
                yield pa.RecordBatch.from_pydict({"token": pa.array(token.view(np.int64), pa.int64()), "n": pa.array(n, pa.int64())})

    reported = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    bound = max(least, share / 2 * docs.count())
    return np.sort(np.array([r["token"] for r in reported.where(F.col("n") >= bound).select("token").collect()], np.int64).view(np.uint64))


#: Rows between steps: of documents (doc_id, a, b, n), packed tokens (high, low, counts, classes and, counted, often), hot tokens of a class (a, high), sizes (classes, counts).
_MAPPED = "bucket int, kind int, origin int, doc_id long, a long, b long, n int, high binary, low binary, counts binary, classes binary, often binary"
#: Rows of documents, and classes that may have a partner (a, n, most, single, tokens).
_FOUND = "kind int, doc_id long, a long, b long, n int, most int, single int, tokens binary"
_DOC, _PACKED, _HOT, _SIZE = range(4)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMAS = {text: pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in text.split(", ")]) for text in (_MAPPED, _FOUND)}
#: Where hot tokens stand in the order: behind all that are counted.
_OFTEN = 255
_LOW = np.uint64(0xFFFFFF)


def _bucket_of(token: np.ndarray, buckets: int) -> np.ndarray:
    return (token & _LOW) % np.uint64(buckets)


def _table(schema: str, rows: int, **columns) -> pa.Table:
    """A table of the schema; columns that are not given are null."""
    return pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _SCHEMAS[schema]], schema=_SCHEMAS[schema])


def _same(value: int, rows: int) -> pa.Array:
    return pa.array(np.full(rows, value, np.int32))


def _ids(high40: np.ndarray, bucket) -> np.ndarray:
    """One 63-bit number for 40 bits of a token and its bucket."""
    return (high40.astype(np.int64) << 23) | bucket


def _spread(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """A row for each document, packed postings by bucket, and the hot tokens of classes."""
    held = docs.sparkSession.sparkContext.broadcast(Known(hot))

    @lean
    def run(batches):
        seen: set[int] = set()
        at = 0
        for b in (part for whole in batches for part in slices(whole, "text", 2 << 20)):
            rows: list[tuple] = []
            posts, owners, lengths, hots, hot_owners = [], [], [], [], []
            for part in slices(b, "text", 1 << 20):
                sets = token_sets(*buffers(part.column(1)))
                some = [s for s in sets if len(s)]
                keys = iter(zip(*(k.tolist() for k in class_keys(some)))) if some else iter(())
                for doc_id, s in zip(part.column(0).to_pylist(), sets):
                    at += 1
                    key = next(keys) if len(s) else (None, None)
                    rows.append((at % buckets, doc_id, *key, len(s)))
                    if len(s) and key[0] not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(key[0])
                        lengths.append(len(s))
                        hit = held.value.positions(s)
                        if len(hit):
                            hots.append(s[hit])
                            hot_owners.append(key[0])
                            s = np.delete(s, hit)
                        posts.append(s)
                        owners.append(key[0])
            cols = list(zip(*rows))
            k = len(rows)
            yield from _table(_MAPPED, k, bucket=pa.array(cols[0]), kind=_same(_DOC, k), doc_id=pa.array(cols[1], pa.int64()), a=pa.array(cols[2], pa.int64()), b=pa.array(cols[3], pa.int64()), n=pa.array(cols[4])).to_batches()
            if hots:
                k = len(hots)
                ids = [_ids(x >> np.uint64(24), _bucket_of(x, buckets).astype(np.int64)).tobytes() for x in hots]
                yield from _table(_MAPPED, k, bucket=pa.array(np.arange(k) % buckets), kind=_same(_HOT, k), a=pa.array(hot_owners, pa.int64()), high=pa.array(ids, pa.binary())).to_batches()
            if posts:
                classes = np.array(owners, np.int64)
                yield from _packed(posts, classes, buckets).to_batches()
                group, sizes = _group_of(classes, buckets), np.array(lengths, np.uint32)
                own = [(g, np.flatnonzero(group == g)) for g in np.unique(group).tolist()]
                packed = {"classes": pa.array([classes[x].tobytes() for _, x in own], pa.binary()), "counts": pa.array([sizes[x].tobytes() for _, x in own], pa.binary())}
                yield from _table(_MAPPED, len(own), bucket=pa.array([g for g, _ in own]), kind=_same(_SIZE, len(own)), **packed).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MAPPED)


def _packed(posts: list[np.ndarray], classes: np.ndarray, buckets: int) -> pa.Table:
    """A row for each bucket: its tokens (40 bits, in two parts), by class."""
    token = np.concatenate(posts)
    owner = np.repeat(np.arange(len(posts), dtype=np.int32), [len(p) for p in posts])
    bucket = _bucket_of(token, buckets).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    return _packed_rows(bucket[order], token[order] >> np.uint64(24), owner[order], classes)


def _packed_rows(bucket: np.ndarray, token: np.ndarray, owner: np.ndarray, classes: np.ndarray, often: np.ndarray | None = None, origin: int = 0) -> pa.Table:
    """Packed rows of tokens that are sorted by bucket and, in it, owner (a place in classes)."""
    high, low = (token >> np.uint64(8)).astype(np.uint32), token.astype(np.uint8)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        first = np.flatnonzero(np.r_[True, owner[a + 1 : b] != owner[a : b - 1], True])
        out.append((int(bucket[a]), high[a:b].tobytes(), low[a:b].tobytes(), np.diff(first).astype(np.uint32).tobytes(), classes[owner[a:b][first[:-1]]].tobytes(), None if often is None else often[a:b].tobytes()))
    cols, k = list(zip(*out)) or [()] * 6, len(out)
    return _table(_MAPPED, k, bucket=pa.array(cols[0], pa.int32()), kind=_same(_PACKED, k), origin=_same(origin, k), **{c: pa.array(x, pa.binary()) for c, x in zip(("high", "low", "counts", "classes", "often"), cols[1:])})


def _joined(t: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(column)])


def _group_of(a: np.ndarray, groups: int) -> np.ndarray:
    """The group in which a class's tokens are gathered."""
    return (mixed(np.asarray(a, np.int64).view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _bucket(t: pa.Table, groups: int) -> pa.Table:
    """Of postings: each class's tokens that another class has too, with the number of classes (up to _OFTEN), dealt out by
    class as hot tokens are too. Rows of documents stay where they are, as copies of one text may be many."""
    bucket = t.column("bucket")[0].as_py()
    kind = t.column("kind").to_numpy()
    rest = t.filter(pa.array(kind != _PACKED))
    group = np.where(kind[kind != _PACKED] == _HOT, _group_of(rest.column("a").fill_null(0).to_numpy(), groups), bucket)
    out = [rest.set_column(0, "bucket", pa.array(group)).cast(_SCHEMAS[_MAPPED])]
    t = t.filter(pa.array(kind == _PACKED)).select(["high", "low", "counts", "classes"])
    if t.num_rows:
        high, low = _joined(t, "high", np.uint32), _joined(t, "low", np.uint8)
        known, number = np.unique(_joined(t, "classes", np.int64), return_inverse=True)
        owner = np.repeat(number.astype(np.uint32), _joined(t, "counts", np.uint32))
        del t, number  # the table is as large as what was read out of it
        place = _group_of(known, groups)
        order = np.argsort(place, kind="stable")  # classes by group, so that owners are numbered in it
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        known, place, owner = known[order], place[order], rank[owner]
        assert len(known) <= 1 << 24, "more classes than a bucket may have"
        parts = min(256, 1 + len(high) // PART)
        for part in range(parts):  # a token's low byte says in which part it is counted
            own = slice(None) if parts == 1 else low % parts == part
            # 40 bits of a token and 24 of its class in one word, so that one sort does; a class that several tasks posted counts once
            word = distinct((high[own].astype(np.uint64) << np.uint64(32)) | (low[own].astype(np.uint64) << np.uint64(24)) | owner[own])
            token = word >> np.uint64(24)
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            length = np.diff(np.r_[first, len(token)])
            df = np.repeat(np.minimum(length, _OFTEN).astype(np.uint8), length)
            word, df = word[df > 1], df[df > 1]
            own = (word & _LOW).astype(np.uint32)
            order = np.argsort(own, kind="stable")
            word, df, own = word[order], df[order], own[order]
            out.append(_packed_rows(place[own], word >> np.uint64(24), own, known, df, bucket))
    return pa.concat_tables(out)


@lean
def _gathered(t: pa.Table) -> pa.Table:
    """Rows of documents, and of the classes of a group those that may have a partner: their shared tokens in the order of
    the number of classes that have them, how many of those lie in the prefix, and how many of these are indexed singly."""
    kind = t.column("kind").to_numpy()
    rows = t.filter(pa.array(kind == _DOC))
    out = [_table(_FOUND, rows.num_rows, **{c: rows.column(c).combine_chunks() for c in ("kind", "doc_id", "a", "b", "n")})]
    packed, hot = t.filter(pa.array(kind == _PACKED)), t.filter(pa.array(kind == _HOT))
    a, token, df = [], [], []
    for x in packed.select(["origin", "high", "low", "counts", "classes", "often"]).to_batches():
        for r in x.to_pylist():
            high, low = np.frombuffer(r["high"], np.uint32), np.frombuffer(r["low"], np.uint8)
            a.append(np.repeat(np.frombuffer(r["classes"], np.int64), np.frombuffer(r["counts"], np.uint32)))
            token.append(_ids((high.astype(np.uint64) << np.uint64(8)) | low, r["origin"]))
            df.append(np.frombuffer(r["often"], np.uint8))
    seen = set()
    for k, x in zip(hot.column("a").to_pylist(), hot.column("high").to_pylist()):
        if k not in seen:
            seen.add(k)
            token.append(np.frombuffer(x, np.int64))
            a.append(np.full(len(token[-1]), k, np.int64))
            df.append(np.full(len(token[-1]), _OFTEN, np.uint8))
    if a:
        a, token, df = np.concatenate(a), np.concatenate(token), np.concatenate(df)
        known, number, held = np.unique(a, return_inverse=True, return_counts=True)
        sizes = t.filter(pa.array(kind == _SIZE))
        sized, at = np.unique(_joined(sizes, "classes", np.int64), return_index=True)
        n = _joined(sizes, "counts", np.uint32)[at][np.searchsorted(sized, known)].astype(np.int64)
        able = held >= -(-3 * n // 4)
        keep = able[number]
        number, token, df = number[keep], token[keep], df[keep]
        order = np.lexsort((token, df, number))
        number, token, df = number[order], token[order], df[order]
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else np.zeros(1, int)
        known, n, held = known[able], n[able], held[able]
        most = held - -(-3 * n // 4) + 1
        seldom = np.add.reduceat((df <= FREQUENT).astype(np.int64), first[:-1]) if len(known) else held
        k = len(known)
        tokens = pa.array([token[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary())
        out.append(_table(_FOUND, k, kind=_same(_PACKED, k), a=pa.array(known), n=pa.array(n), most=pa.array(most), single=pa.array(np.minimum(most, seldom)), tokens=tokens))
    return pa.concat_tables(out)


def _least_overlap(n):
    """Of a class of n tokens with any partner."""
    return F.ceil(n * 3 / 4)


def _exploded(held: DataFrame, upto: str | None = None) -> DataFrame:
    """a, n and token of each class's tokens, or of the first `upto` of them."""

    @lean
    def run(batches):
        for whole in batches:
            for b in slices(whole, "tokens", 4 << 20):
                parts = [np.frombuffer(x.as_py(), np.int64) for x in b.column(2)]
                if upto:
                    parts = [p[:m] for p, m in zip(parts, b.column(3).to_pylist())]
                n = [len(p) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(np.repeat(b.column(1).to_numpy(), n)), pa.array(np.concatenate(parts))], ["a", "n", "token"])

    return held.select("a", "n", "tokens", *([upto] if upto else [])).mapInArrow(run, "a long, n int, token long")


def _single_pairs(held: DataFrame) -> DataFrame:
    """Distinct pairs of classes, of sizes that allow the threshold, that share a token which is indexed singly; at most FREQUENT classes do."""
    group = _exploded(held, "single").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("a", "n"))).alias("g")).where(F.size("g") > 1)
    fits = lambda x, y: 4 * F.least(x["n"], y["n"]) >= 3 * F.greatest(x["n"], y["n"])
    pairs = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: (y["a"] > x["a"]) & fits(x, y)), lambda y: F.struct(x["a"].alias("a"), y["a"].alias("b")))))
    return group.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose sets reach the threshold.

    Classes fall into blocks of about BLOCK by hash; a pair belongs to its two blocks, to
    which each set that they need is sent once, however many of their pairs need it.
    """
    n = F.lit(max(8, held.count() // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), n)
    placed = pairs.select("a", "b", (block("a") * n + block("b")).alias("g"))
    wanted = placed.select(F.col("g").alias("h"), F.explode(F.array("a", "b")).alias("a")).distinct()
    sent = wanted.join(held, "a").select("h", "a", "n", "tokens")

    @lean
    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {a: (n, np.frombuffer(x.as_py(), np.int64)) for a, n, x in zip(right.column("a").to_pylist(), right.column("n").to_pylist(), right.column("tokens"))}
        ok = [_linked(*sets[a], *sets[b]) for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist())]
        return left.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return placed.groupBy("g").cogroup(sent.groupBy("h")).applyInArrow(check, "a long, b long").distinct()


def _linked(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
    """Whether sets of n and m tokens with the shared tokens x and y reach the threshold."""
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= 75 * (n + m - same)


def components(edges: DataFrame) -> DataFrame:
    """node and the least node of its component (label), for all nodes with an edge; edges: a, b.

    A forest of each partition's edges first, then large-star and small-star rounds until
    nothing moves; each round is a table in the shared folder.
    """

    @lean
    def forest(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        def out():
            return pa.RecordBatch.from_pydict({"u": pa.array(list(parent), pa.int64()), "v": pa.array([root(x) for x in list(parent)], pa.int64())})

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            if len(parent) > 1_000_000:
                yield out()
                parent.clear()
        if parent:
            yield out()

    links = written(edges.select("a", "b").mapInArrow(forest, "u long, v long").where("u <> v").distinct(), "jaccard-star")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, links = links, written(small, "jaccard-star")
        discarded(before)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        state = now


def _relabelled(token: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens with their class's component c; and the tokens of two components or more with the number of those and a
    key of which they are: tokens of the same components are one bundle."""
    own = token.join(label.withColumnRenamed("node", "a"), "a", "left").select("a", F.coalesce("label", "a").alias("c"), "n", "token")
    held = own.select("token", "c").distinct().groupBy("token").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("c")).alias("x")).where("df > 1")
    return own, held.select("token", "df", F.xxhash64("x", "df").alias("bundle"))


def frequent_among(hard: int) -> int:
    """Components that may share a token for it to be indexed singly, of so many hard classes."""
    return max(FREQUENT, min(hard // 4, FREQUENT_HARD))


def prefix_keys(token: DataFrame, label: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Keys of the extended prefixes of hard classes: a, its component c, the key k and whether it is a combination of two tokens.

    Tokens of one component come first in the order and cannot be shared across; of the
    others as many as are left of n - ceil(0.75 n) + 2 belong to the prefix. Tokens that the
    same components have (those of one passage) are interchangeable as keys: a bundle
    stands for them, and is combined with itself where two of its tokens are there.
    """
    mine, spread = _relabelled(token, label)
    held = mine.join(spread, "token").groupBy("a", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token", "bundle"))).alias("shared"))
    left = F.size("shared") - _least_overlap(F.col("n")) + 2
    prefix = held.withColumn("left", left.cast("int")).where("left > 1").select("a", "c", F.slice("shared", 1, F.col("left")).alias("p"))
    often = F.transform(F.filter("p", lambda x: x["df"] > frequent), lambda x: x["bundle"])
    seldom = F.array_distinct(F.transform(F.filter("p", lambda x: x["df"] <= frequent), lambda x: x["bundle"]))
    one = F.array_sort(F.array_distinct("often"))
    pairs = F.flatten(F.transform("one", lambda x, i: F.transform(F.slice(F.col("one"), i + 2, F.size("one")), lambda y: F.xxhash64(x, y))))
    own = F.transform(F.filter("one", lambda x: F.size(F.filter("often", lambda y: x == y)) > 1), lambda x: F.xxhash64(x, x))
    key = lambda column, combined: F.transform(column, lambda x: F.struct(x.alias("k"), F.lit(combined).alias("combined")))
    keys = F.concat(key(F.col("seldom"), False), key(F.concat(pairs, own), True))
    return prefix.select("a", "c", often.alias("often"), seldom.alias("seldom")).withColumn("one", one).select("a", "c", F.explode(keys).alias("x")).select("a", "c", "x.*")


def _hard_links(held: DataFrame, links: DataFrame, label: DataFrame, report: dict | None = None) -> DataFrame:
    """links and those among hard classes (rows of held) that single tokens may have missed.

    First a round of stars: each class tries, for a few of its tokens that other components
    have too, the class that the token's hash puts first. It joins most of a group of near
    copies at a cost of its members. Then the classes that prefixes leave are compared in
    blocks, where only links come out, never pairs.
    """
    token = written(_exploded(held), "jaccard-hard")
    fits = "4 * least(n, m) >= 3 * greatest(n, m)"
    for turn in range(ROUNDS):
        mine, spread = _relabelled(token, label)
        shared = written(mine.join(spread.select("token"), "token"), "jaccard-shared")
        if shared.isEmpty():
            return links
        seed = F.lit(turn)
        order = F.row_number().over(W.partitionBy("a").orderBy(F.xxhash64("token", seed), "token"))
        few = shared.withColumn("r", order).where(F.col("r") <= TRIES)
        first = shared.groupBy("token").agg(F.min_by(F.struct(F.col("a").alias("b"), F.col("c").alias("d"), F.col("n").alias("m")), F.xxhash64("a", "token", seed)).alias("f")).select("token", "f.*")
        tried = few.join(first, "token").where("c <> d").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = written(_verified(tried, held), "jaccard-links")
        discarded(shared)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        label = components(links)

    keys = written(prefix_keys(token, label, frequent_among(held.count())), "jaccard-keys")
    discarded(token)
    if report is not None:
        report |= {("combined" if r["combined"] else "single") + "_hard_keys": r["count"] for r in keys.groupBy("combined").count().collect()}

    # Classes that share keys mostly share the least class of a key: their family. Families are cut into blocks; blocks meet where they share a key.
    family = keys.join(keys.groupBy("k").agg(F.min("a").alias("l")), "k").groupBy("a", "c").agg(F.min("l").alias("f"))
    members = family.groupBy("f").agg(F.count("*").alias("m"))
    part = F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / FAMILY_BLOCK))
    placed = written(family.join(members, "f").select("a", "c", F.xxhash64("f", part).alias("block")), "jaccard-blocks")
    of_key = keys.join(placed.select("a", "block"), "a").select("k", "block").distinct()
    meet = of_key.join(of_key.select("k", F.col("block").alias("other")), "k").where("block <= other").select("block", "other").distinct()
    meet = meet.select(F.xxhash64("block", "other").alias("g"), F.explode(F.array_distinct(F.array(F.struct("block", F.lit(0).alias("side")), F.struct(F.col("other").alias("block"), F.when(F.col("block") == F.col("other"), 0).otherwise(1).alias("side"))))).alias("x")).select("g", "x.*")
    sent = meet.join(placed, "block").join(held, "a").select("g", "side", "a", "c", "n", "tokens")
    more = written(sent.groupBy("g").applyInArrow(_forest_across, "a long, b long"), "jaccard-links")
    discarded(keys, placed)
    return links.unionByName(more)


@lean
def _forest_across(t: pa.Table) -> pa.Table:
    """Links between the two sides (or within the one) that join components, as a forest of them; the overlaps of all pairs are counted exactly."""
    side, a, c, size = (t.column(k).to_numpy() for k in ("side", "a", "c", "n"))
    sets = [np.frombuffer(x.as_py(), np.int64) for x in t.column("tokens")]
    n = size.astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    owner, column = owner[keep], number[place[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    same = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[i:j], column[i:j] - lo] = 1
        same += held @ held.T
    same = same.astype(np.int64)
    ok = (100 * same >= 75 * (n[:, None] + n - same)) & (c[:, None] != c)
    ok &= np.triu(np.ones_like(ok), 1) if side.max() == 0 else (side[:, None] < side)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    out = []
    for i, j in zip(*np.nonzero(ok)):
        p, q = root(int(c[i])), root(int(c[j]))
        if p != q:
            parent[p] = q
            out.append((int(a[i]), int(a[j])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def joined(docs: DataFrame, buckets: int | None = None, report: dict | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles and component_id. report gets the numbers of keys that were indexed."""
    buckets = min(buckets or partitions_for(docs, 10 << 20), 1 << 23)
    tokens = _spread(docs, buckets, hot_tokens(docs)).groupBy("bucket").applyInArrow(lean(lambda t: _bucket(t, buckets)), _MAPPED)
    found = written(tokens.groupBy("bucket").applyInArrow(_gathered, _FOUND), "jaccard-found")
    rows = found.where(F.col("kind") == _DOC)
    sized = written(rows.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n")), "jaccard-classes")
    held = found.where(F.col("kind") == _PACKED).select("a", "n", "most", "single", "tokens")
    pairs = written(_single_pairs(held), "jaccard-pairs")
    links = written(_verified(pairs, held), "jaccard-links")
    discarded(pairs)
    if report is not None:
        report |= {"candidates": held.count(), "single_keys": held.agg(F.coalesce(F.sum("single"), F.lit(0))).first()[0], "hard": held.where("single < most").count()}
    label = components(links)
    hard = held.where("single < most")
    if not hard.isEmpty():
        label = components(_hard_links(hard, links, label, report))
    member = sized.join(label.withColumnRenamed("node", "a"), "a").select("a", "b", "label", "doc")
    least = member.groupBy("label").agg(F.min("doc").alias("component"))
    of_class = sized.join(member.join(least, "label").select("a", "b", "component"), ["a", "b"], "left").select("a", "b", F.coalesce("component", "doc").alias("component"))
    return rows.join(of_class, ["a", "b"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of docs but those of a group's other documents: of each component the least doc_id stays; docs' columns.

    The ids that go are looked up in a Bloom filter, so that only rows that it lets through
    are dealt out for the exact anti-join.
    """
    gone = written(joined(docs).where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-gone")
    bitmap, at = docs.sparkSession.sparkContext.broadcast(bloom(gone)), docs.columns.index("doc_id")

    def part(inside: bool):
        @lean
        def run(batches):
            for b in batches:
                ids = b.column(at).cast(pa.int64())
                hit = in_bitmap(bitmap.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ~ids.is_null().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit == inside))

        return docs.mapInArrow(run, docs.schema)

    return part(False).unionByName(part(True).join(gone, "doc_id", "left_anti"))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The same result by comparing all pairs of word sets; for tests."""
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))
        sets.append({tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for k, (doc_id, _) in enumerate(docs):
        r = root(k)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(doc_id, len(sets[k]), None if doc_id is None else least[root(k)]) for k, (doc_id, _) in enumerate(docs)]


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT r, v FROM (SELECT r, array_to_string(w[p:p + 4], ' ') AS v FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0))),
size AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
link AS (SELECT x.r AS a, y.r AS b FROM sh x JOIN sh y ON x.v = y.v AND x.r < y.r GROUP BY x.r, y.r
         HAVING 100 * count(*) >= 75 * ((SELECT n FROM size WHERE size.r = x.r) + (SELECT n FROM size WHERE size.r = y.r) - count(*))),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
least_ AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.b = d.r GROUP BY reach.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN d.doc_id IS NOT NULL THEN component_id END AS component_id
FROM d LEFT JOIN size USING (r) LEFT JOIN least_ USING (r)"""
