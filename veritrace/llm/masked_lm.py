"""Masked pseudo-likelihood of texts under a bidirectional window network.

Each word is predicted from the two words on either side: a hidden layer sums an embedding
for each neighbour and place, and a two-level softmax gives the word's class and the word
within its class. A text's score is the sum of log p(word | neighbours) over all its words.

The vocabulary is the most frequent words by exact counts over all documents; other words
fall into hashed places of the last class. The network is trained in numpy on all documents
(TRAIN_SHARE is the whole), in shards of about SHARD_WORDS words: every shard trains from the same start, the weights are
averaged by words, for ROUNDS rounds.

Odd inputs. Null and empty texts have no words and score 0. Very long texts are scored whole,
in segments. Words with the same count are ordered by hash. Repeated rows train and score
each; without any word the network stays as it starts. An empty table gives an empty one.
Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WHITE, buffers, lean, slices, word_spans, written

CLASSES = WIDTH = 64
VOCABULARY = CLASSES * WIDTH
PAD = VOCABULARY
PLACES, HIDDEN = (-2, -1, 1, 2), 16
TRAIN_SHARE, SHARD_WORDS, ROUNDS = 1.0, 400_000, 2
#: Words of a training step: a pass over a full shard takes about PASS_STEPS of them, between these bounds. The rate is for
#: the least; it grows with the square root of a step's words.
PASS_STEPS, STEP_WORDS, RATE = 48, (2048, 8192), 0.2
#: Words that are scored at once, and of those (or of a step) the rows whose arrays fit a core's cache.
CHUNK, GROUP_ROWS = 1 << 13, 1 << 12
#: Bits of a word's hash that lead to its place among the known ones.
FIRST_BITS = 14
#: Entries up to this, and not below its negative, keep their digits in exp's sums of 32 bits, and those times a step's words.
SMALL = 60
#: Slices of the weights that are averaged apart.
SLICES = 16


def word_counts(docs: DataFrame) -> DataFrame:
    """Word hash and its count, over all documents."""

    @lean
    def run(batches):
        known, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        more, waiting = [], 0  # counts of slices; they are added up when there are as many as known ones

        def added():
            h, c = (np.concatenate(x) for x in zip((known, count), *more))
            order = np.argsort(h)
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            return h[first], np.add.reduceat(c[order], first) if len(h) else c

        def out():
            return pa.RecordBatch.from_pydict({"h": pa.array(known.view(np.int64), pa.int64()), "n": pa.array(count, pa.int64())})

        for whole in batches:
            for b in slices(whole, "text"):
                more.append(np.unique(word_spans(*buffers(b.column(0)), WHITE, LOWER)[2], return_counts=True))
                waiting += len(more[-1][0])
                if waiting > len(known):
                    known, count = added()
                    more, waiting = [], 0
                    if len(known) > 1_000_000:
                        yield out()
                        known, count = known[:0], count[:0]
        known, count = added()
        if len(known):
            yield out()

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    def __init__(self, hashes: list[int]):
        """hashes: of the words, most frequent first."""
        h = np.array(hashes, np.int64).view(np.uint64)[: VOCABULARY - WIDTH]
        order = np.argsort(h)
        self.known, self.ids = h[order], order.astype(np.int64)
        # the first known hash of each value of the first bits: a word passes over few
        self.first = np.searchsorted(self.known, np.arange(1 << FIRST_BITS, dtype=np.uint64) << np.uint64(64 - FIRST_BITS)).astype(np.int32)
        self.most = int(np.diff(np.append(self.first, len(h))).max())

    def of(self, h: np.ndarray) -> np.ndarray:
        other = VOCABULARY - WIDTH + (h >> np.uint64(58)).astype(np.int64)
        if not len(self.known):
            return other
        k, last = self.first[(h >> np.uint64(64 - FIRST_BITS)).astype(np.int64)], len(self.known) - 1
        np.minimum(k, last, out=k)
        for _ in range(self.most - 1):
            k += self.known[k] < h
            np.minimum(k, last, out=k)
        return np.where(self.known[k] == h, self.ids[k], other)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The most frequent words; ties by hash. A histogram of counts by powers of two gives a bound below which no word
    can be among them, so that no task and no driver sees more than the words above it."""
    most = VOCABULARY - WIDTH
    words = word_counts(docs).persist()  # read twice; a lost part is counted again
    power = F.floor(F.log2("n")).cast("int")
    bound, above = 1, 0
    for r in words.groupBy(power.alias("p")).count().orderBy(F.desc("p")).collect():
        above += r["count"]
        if above >= most:
            bound = 1 << r["p"]
            break
    top = words.where(F.col("n") >= bound).orderBy(F.desc("n"), "h").limit(most).repartition(1).collect()
    words.unpersist()
    return Vocabulary([r["h"] for r in sorted(top, key=lambda r: (-r["n"], r["h"]))])


_PLACE_AT, _PLACE_SHIFT = (np.arange(len(PLACES)) * (VOCABULARY + 1)).astype(np.uint16), (len(PLACES) - 1).bit_length()
#: A row of embeddings as one item, which numpy puts in its place at once.
_ROW = np.dtype(("V", 4 * HIDDEN))


class Work:
    """Arrays of up to `rows` rows that steps use in turn: large ones that come and go are mapped anew by the system each time."""

    def __init__(self, rows: int):
        narrow = lambda: np.empty((rows, HIDDEN), np.float32)
        self.sums, self.more, self.back = narrow(), narrow(), narrow()
        self.hidden, self.ones = np.ones((rows, HIDDEN + 1), np.float32), np.ones(rows, np.float32)  # the last column of hidden stays 1, for biases
        self.both = np.empty((min(rows, GROUP_ROWS), CLASSES + WIDTH), np.float32)
        self.spread = np.empty((rows * len(PLACES), HIDDEN), np.float32)
        self.weights, self.bias = np.zeros((CLASSES, HIDDEN, CLASSES + WIDTH), np.float32), np.zeros((CLASSES, CLASSES + WIDTH), np.float32)


class Heads:
    """Of each class, the weights of all classes and of its own words side by side, and below them the biases, so that one
    product serves all."""

    def __init__(self, net: Network):
        self.all = np.empty((CLASSES, HIDDEN + 1, CLASSES + WIDTH), np.float32)
        self.weights, self.bias = self.all[:, :HIDDEN], self.all[:, HIDDEN]
        self.fill(net)

    def fill(self, net: Network) -> None:
        self.weights[:, :, :CLASSES], self.weights[:, :, CLASSES:] = net.cls, net.word
        self.bias[:, :CLASSES], self.bias[:, CLASSES:] = net.cls_bias, net.word_bias
        # no logit is beyond this, as hidden entries are between -1 and 1
        most = max(np.abs(net.cls).sum(0).max(), np.abs(net.word).sum(1).max()) + max(np.abs(net.cls_bias).max(), np.abs(net.word_bias).max())
        self.small = bool(most < SMALL)


class Network:
    """Weights in one vector; the parts are views of it."""

    SHAPES = (("embed", (len(PLACES), VOCABULARY + 1, HIDDEN)), ("hidden", (HIDDEN,)), ("cls", (HIDDEN, CLASSES)), ("cls_bias", (CLASSES,)), ("word", (CLASSES, HIDDEN, WIDTH)), ("word_bias", (CLASSES, WIDTH)))
    SIZE = sum(int(np.prod(s)) for _, s in SHAPES)

    def __init__(self, vector: np.ndarray | None = None):
        if vector is None:
            vector = np.random.default_rng(7).normal(0, 0.1, self.SIZE).astype(np.float32)
        self.vector, at = vector, 0
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            setattr(self, name, vector[at : at + n].reshape(shape))
            at += n
        self.flat, self.dense = self.embed.reshape(-1, HIDDEN), vector[self.embed.size :]

    def forward(self, context: np.ndarray, work: Work | None = None) -> np.ndarray:
        """The hidden layer, and a column of ones."""
        n = len(context)
        work = work or Work(n)
        h, more, out = work.sums[:n], work.more[:n], work.hidden[:n]
        self.embed[0].take(context[:, 0], axis=0, out=h, mode="clip")  # with "raise", numpy would copy
        for p in range(1, len(PLACES)):
            h += self.embed[p].take(context[:, p], axis=0, out=more, mode="clip")
        h += self.hidden
        # tanh(x) = 1 - 2 / (exp(2 x) + 1), quicker than numpy's
        h += h
        with np.errstate(over="ignore"):
            np.exp(h, out=h)
        h += 1
        np.divide(-2, h, out=h)
        np.add(h, 1, out=out[:, :HIDDEN])
        return out

    @staticmethod
    def _logits(h: np.ndarray, heads: Heads, spans, start: int, work: Work) -> np.ndarray:
        """Of classes and of the words of each row's class, side by side; spans: class and its rows (i, j), of which h has those from start."""
        both = work.both[: len(h)]
        for c, i, j in spans:
            np.matmul(h[i - start : j - start], heads.all[c], out=both[i - start : j - start])
        return both

    def log_p(self, context: np.ndarray, target: np.ndarray, work: Work | None = None, heads: Heads | None = None) -> np.ndarray:
        work, heads = work or Work(len(target)), heads or Heads(self)
        order, spans, at = _by_class(target)
        context = context.take(order, axis=0)
        found = np.empty(len(order), np.float32)
        for i, j, own in _groups(spans):
            both = self._logits(self.forward(context[i:j], work), heads, own, i, work)
            p = both.reshape(-1).take(at[:, i:j] - i * (CLASSES + WIDTH))
            top, total = _exponents(both.reshape(-1, WIDTH), heads.small)
            np.log(total, out=total)
            total += top
            np.add(p[0], p[1], out=found[i:j])
            found[i:j] -= total[::2]
            found[i:j] -= total[1::2]
        out = np.empty(len(order), np.float32)
        out[order] = found
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray) -> Network:
        """Of the mean negative log-likelihood."""
        g = Network(np.zeros(self.SIZE, np.float32))
        self.gradient_into(g, context, target)
        return g

    def gradient_into(self, g: Network, context: np.ndarray, target: np.ndarray, work: Work | None = None) -> None:
        """Writes the gradient to g, but for embeddings of neighbours that do not occur."""
        own, rows = self.gradient_parts(g, context, target, work or Work(len(target)), Heads(self))
        g.flat[own] = rows

    def gradient_parts(self, g: Network, context: np.ndarray, target: np.ndarray, work: Work, heads: Heads) -> tuple[np.ndarray, np.ndarray]:
        """Writes the gradient without its embeddings to g; returns the places of those that occur in g.flat, and their gradient."""
        order, spans, at = _by_class(target)
        context, n = context.take(order, axis=0), len(target)
        ones, back, weights, bias = work.ones[:n], work.back[:n], work.weights, work.bias
        if len(spans) < CLASSES:
            weights[:], bias[:] = 0, 0
        last = -1
        for start, end, own in _groups(spans):
            h = self.forward(context[start:end], work)
            both = self._logits(h, heads, own, start, work)
            d = both.reshape(-1, WIDTH)  # softmax less one at the target, over n
            _, total = _exponents(d, heads.small)
            total *= n
            d *= np.reciprocal(total, out=total)[:, None]
            both.reshape(-1)[at[:, start:end] - start * (CLASSES + WIDTH)] -= np.float32(1 / n)
            b, h = back[start:end], h[:, :HIDDEN]
            for c, i, j in own:
                rows = slice(i - start, j - start)
                mine = both[rows]
                if c == last:  # another part of a long span
                    weights[c] += h[rows].T @ mine
                    bias[c] += ones[: j - i] @ mine
                else:
                    np.matmul(h[rows].T, mine, out=weights[c])
                    np.matmul(ones[: j - i], mine, out=bias[c])
                np.matmul(mine, heads.weights[c].T, out=b[rows])
                last = c
            slope = np.multiply(h, h, out=work.more[: end - start])
            np.subtract(1, slope, out=slope)
            b *= slope
        weights[:, :, :CLASSES].sum(0, out=g.cls)
        bias[:, :CLASSES].sum(0, out=g.cls_bias)
        g.word[:], g.word_bias[:], g.hidden[:] = weights[:, :, CLASSES:], bias[:, CLASSES:], ones @ back
        # all places in one pass: row p * (VOCABULARY + 1) + word of the flat table
        ids = (context + _PLACE_AT).ravel() if context.dtype == np.uint16 else (context.astype(np.uint16) + _PLACE_AT).ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        order >>= _PLACE_SHIFT
        spread = back.take(order, axis=0, out=work.spread[: len(order)], mode="clip")
        # two columns are added up as one complex number, which takes half the calls
        return ids[first].astype(np.int64), np.add.reduceat(spread.view(np.complex64), first, axis=0).view(np.float32)


def _exponents(x: np.ndarray, small: bool) -> tuple[np.ndarray | np.float32, np.ndarray]:
    """A bound of each row, and its sum of exp(x - that); x becomes the exponents. The bound is 0 where all entries are
    small enough for that (small: they are known to be), else the row's maximum."""
    top = np.float32(0)
    if not small and x.size and not (x.max() < SMALL and x.min() > -SMALL):
        top = x.max(1)
        x -= top[:, None]
    np.exp(x, out=x)
    return top, x @ np.ones(x.shape[1], np.float32)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """Rows in the order of their classes; (class, first row, end) of each; and where in that order, in a table of rows of
    CLASSES + WIDTH, each row's class is and its word within the class."""
    cls = (target // WIDTH).astype(np.uint8)
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    first = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]) if len(cls) else np.zeros(0, int)
    at = np.empty((2, len(cls)), np.int64)
    at[:] = np.arange(len(cls)) * (CLASSES + WIDTH)
    at[0] += cls
    at[1] += CLASSES + target.take(order) % WIDTH
    return order, list(zip(cls[first].tolist(), first.tolist(), [*first[1:].tolist(), len(cls)])), at


def _groups(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Spans of up to GROUP_ROWS rows together: first row, end, and the spans; a longer span comes in parts."""
    out: list[tuple[int, int, list[tuple[int, int, int]]]] = []
    for c, first, end in spans:
        for i in range(first, end, GROUP_ROWS):
            j = min(i + GROUP_ROWS, end)
            if out and j - out[-1][0] <= GROUP_ROWS:
                start, _, own = out[-1]
                out[-1] = (start, j, [*own, (c, i, j)])
            else:
                out.append((i, j, [(c, i, j)]))
    return out


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Neighbours of each word within its text; PAD beyond its ends."""
    n, reach = np.diff(first), max(PLACES)
    at = np.arange(len(ids)) + np.repeat(reach * (1 + np.arange(len(n))), n)  # texts stand apart by as many pads as the window reaches
    padded = np.full(len(ids) + reach * (len(n) + 1), PAD, np.uint16)
    padded[at] = ids
    return np.stack([padded[at + o] for o in PLACES], axis=1)


def train(network: Network, context: np.ndarray, target: np.ndarray, rate: float = RATE, batch: int | None = None) -> Network:
    """One pass of Adagrad over the words in a fixed order; embeddings whose gradient is zero stay as they are and are passed over."""
    net = Network(network.vector.copy())
    least, most = STEP_WORDS
    batch = batch or min(max(len(target) // PASS_STEPS, least), most)
    rate = np.float32(rate * (batch / least) ** 0.5)
    total, step, heads = Network(np.full(net.SIZE, 1e-6, np.float32)), Network(np.zeros(net.SIZE, np.float32)), Heads(net)
    order, work, spare = np.random.default_rng(3).permutation(len(target)), Work(min(batch, len(target))), np.empty_like(net.dense)
    context, target = context.astype(np.uint16).take(order, axis=0), target.astype(np.uint16).take(order)
    totals, embeds = total.flat.view(_ROW).ravel(), net.flat.view(_ROW).ravel()

    def moved(g: np.ndarray, seen: np.ndarray, now: np.ndarray, spare: np.ndarray) -> None:
        np.multiply(g, g, out=spare)
        seen += spare
        np.sqrt(seen, out=spare)
        np.divide(g, spare, out=spare)
        spare *= rate
        now -= spare

    for at in range(0, len(order), batch):
        own, g = net.gradient_parts(step, context[at : at + batch], target[at : at + batch], work, heads)
        moved(step.dense, total.dense, net.dense, spare)
        seen, now = total.flat.take(own, axis=0), net.flat.take(own, axis=0)
        moved(g, seen, now, np.empty_like(g))
        totals[own], embeds[own] = seen.view(_ROW).ravel(), now.view(_ROW).ravel()
        heads.fill(net)
    return net


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """One row for each document, written once for training and scoring: doc_id, a hash of doc_id and text as key, its number
    of words n, and their places in the vocabulary as ids."""
    words = docs.sparkSession.sparkContext.broadcast(vocab)

    @lean
    def encode(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                _, _, h, first = word_spans(*buffers(b.column(2)), WHITE, LOWER)
                ids = words.value.of(h).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(first), pa.int64()), pa.array([ids[first[k] : first[k + 1]].tobytes() for k in range(b.num_rows)], pa.binary())], ["doc_id", "key", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    return written(rows.mapInArrow(encode, "doc_id long, key long, n long, ids binary"), "lm-words")


def fit(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, share: float = TRAIN_SHARE) -> Network:
    return learned(encoded(docs, vocab), rounds, share)


def learned(words: DataFrame, rounds: int = ROUNDS, share: float = TRAIN_SHARE) -> Network:
    """words: of encoded()."""
    spark = words.sparkSession
    held = words.where(F.pmod("key", F.lit(1 << 20)) < int(share * (1 << 20))).select(F.pmod(F.shiftright("key", 20), F.lit(1 << 30)).alias("k"), "n", "ids")
    n_words = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-n_words // SHARD_WORDS))
    groups = max(1, round(shards**0.5))
    network, size = Network(), -(-Network.SIZE // SLICES)
    for _ in range(rounds if n_words else 0):
        start = spark.sparkContext.broadcast(network.vector)

        @lean
        def learn(t: pa.Table) -> pa.Table:
            rows = sorted(zip(t.column("k").to_pylist(), t.column("ids").to_pylist()))
            texts = [np.frombuffer(x, np.uint16).astype(np.int64) for _, x in rows]
            first = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
            ids = np.concatenate(texts)
            v = train(Network(start.value), contexts(ids, first), ids).vector * np.float32(len(ids))
            shard = t.column("shard")[0].as_py()
            return pa.table({"s": pa.array(range(SLICES), pa.int32()), "g": pa.array([shard % groups] * SLICES, pa.int32()), "n": pa.array([len(ids)] * SLICES, pa.int64()), "v": pa.array([v[k * size : (k + 1) * size].tobytes() for k in range(SLICES)], pa.binary())})

        @lean
        def add(t: pa.Table) -> pa.Table:
            v = None
            for x in t.column("v"):
                x = np.frombuffer(x.as_py(), np.float32)
                v = x.astype(np.float64) if v is None else v + x
            return pa.table({"s": t.column("s")[:1], "g": t.column("g")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "v": pa.array([v.astype(np.float32).tobytes()], pa.binary())})

        schema = "s int, g int, n long, v binary"
        trained = held.where("n > 0").withColumn("shard", F.pmod("k", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(learn, schema)
        parts = trained.groupBy("s", "g").applyInArrow(add, schema).groupBy("s").applyInArrow(add, schema).collect()
        vector = np.concatenate([np.frombuffer(bytes(r["v"]), np.float32) / np.float32(r["n"]) for r in sorted(parts, key=lambda r: r["s"])])
        network = Network(vector.copy())
    return network


def _log_likelihoods(net: Network, work: Work, heads: Heads, ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Of each text; first: the first word of each, and the end."""
    around, log_p = contexts(ids, first), np.zeros(len(ids) + 1)
    for at in range(0, len(ids), CHUNK):
        log_p[1 + at : 1 + at + CHUNK] = net.log_p(around[at : at + CHUNK], ids[at : at + CHUNK], work, heads)
    total = np.cumsum(log_p)
    return pa.array(total[first[1:]] - total[first[:-1]], pa.float64())


_SCORES = "doc_id long, n_words long, log_likelihood double"


def scored(docs: DataFrame, vocab: Vocabulary, network: Network) -> DataFrame:
    """One row for each document: doc_id, n_words and the sum of its words' log-probabilities."""
    held = docs.sparkSession.sparkContext.broadcast((vocab, network.vector))

    @lean
    def run(batches):
        words, vector = held.value
        net, work = Network(vector), Work(CHUNK)
        heads = Heads(net)
        for whole in batches:
            for b in slices(whole, "text", 1 << 19):
                _, _, h, first = word_spans(*buffers(b.column(1)), WHITE, LOWER)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first), pa.int64()), _log_likelihoods(net, work, heads, words.of(h), first)], ["doc_id", "n_words", "log_likelihood"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCORES)


def scored_words(words: DataFrame, network: Network) -> DataFrame:
    """As scored(), of the rows of encoded(): texts are not scanned again."""
    held = words.sparkSession.sparkContext.broadcast(network.vector)

    @lean
    def run(batches):
        net, work = Network(held.value), Work(CHUNK)
        heads = Heads(net)
        for whole in batches:
            for b in slices(whole, "ids", 1 << 18):
                data, off = buffers(b.column(2))
                ids, first = data[off[0] : off[-1]].view(np.uint16).astype(np.int64), (off - off[0]) // 2
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _log_likelihoods(net, work, heads, ids, first)], ["doc_id", "n_words", "log_likelihood"])

    return words.select("doc_id", "n", "ids").mapInArrow(run, _SCORES)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_p"))
