"""Merkle manifest of a dataset: a digest for each row, a subroot for each source, a root over all, and a proof for each row.

Trees of any size are reduced by superblocks: nodes are grouped by index div fanout**LEVELS, and one call collapses LEVELS
levels of a group; the roots of groups are the next round's nodes. Proofs go the other way: a group's nodes
get their siblings inside the group (the lower proof) in front of the proof of the group's root (the upper one).

Odd inputs: null fields are digested as `-`; rows of a null source are a source that comes first; a null doc_id comes before
all others of its source; rows that share doc_id and source are in the order of their digests, and equal rows have
proofs of their own at neighbouring places; a source of one row has that row's digest as subroot; an
empty table gives no rows and no root. Texts are digested whole. Columns besides the five are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, written
from .ranking import group_key, ranked

FANOUT = 16
#: Levels that one call collapses.
LEVELS = 2
_BLOCK = FANOUT**LEVELS
#: Nodes that a group holds, besides the last of its blocks: small trees share a call.
_PACK = 4 * _BLOCK
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "t long, i long, size long, start long, digest string, below long"

#: A path is a text of runs, from the leaf's to the root's, joined by `/`; in each run HOLE stands for the node itself.
HOLE, STEP = ".", "/"


def digest_of(*columns: Column) -> Column:
    """Digest of fields: each is `-` if null, else its bytes in UTF-8 behind their number."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]), 256)


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    up = F.aggregate(F.split(path, STEP), leaf, lambda node, run: F.sha2(F.replace(run, F.lit(HOLE), node), 256))
    return F.when(path == "", leaf).otherwise(up)


def siblings(path: Column) -> Column:
    """The digests of a path one after another, without the node's places."""
    return F.translate(path, HOLE + STEP, "")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(digests: list[str], whole: bool) -> list[list[str]]:
    """Digests by level, from the given one up: LEVELS further ones, or to a single node where these are a whole tree."""
    out = [digests]
    while len(out) <= LEVELS and not (whole and len(out[-1]) == 1):
        d = out[-1]
        out.append([_hash("".join(d[k : k + FANOUT])) for k in range(0, len(d), FANOUT)])
    return out


def _paths(levels: list[list[str]]) -> list[str]:
    """A path within the block for each of the lowest level's nodes."""
    above = [""] * len(levels[-1])
    for d in reversed(levels[:-1]):
        own = []
        for k in range(0, len(d), FANOUT):
            run = d[k : k + FANOUT]
            tail = STEP + above[k // FANOUT] if above[k // FANOUT] else ""
            own += ["".join(run[:j]) + HOLE + "".join(run[j + 1 :]) + tail for j in range(len(run))]
        above = own
    return above


def _blocks(t: np.ndarray, i: np.ndarray):
    """Bounds of the runs of rows, sorted by t and i, that are of one block."""
    b = i // _BLOCK
    cuts = np.flatnonzero((t[1:] != t[:-1]) | (b[1:] != b[:-1])) + 1
    return zip([0, *cuts], [*cuts, len(t)]) if len(t) else ()


def _collapsed(nodes):
    """pandas in, pandas out: the root of each block. `below` names the group that a root's block was in."""
    nodes = nodes.sort_values(["t", "i"])
    t, i, size, start, digest, pack = (nodes[c].to_numpy() for c in ("t", "i", "size", "start", "digest", "pack"))
    rows = [(t[a], i[a] // _BLOCK, -(-size[a] // _BLOCK), start[a] // _BLOCK, _levels(list(digest[a:b]), size[a] <= _BLOCK)[-1][0], pack[a]) for a, b in _blocks(t, i)]
    return type(nodes)(rows, columns=["t", "i", "size", "start", "digest", "below"])


def _group() -> Column:
    """Group of a node: blocks of neighbouring trees come together, a block never comes apart."""
    return F.expr(f"(start + i div {_BLOCK} * {_BLOCK}) div {_PACK}").alias("pack")


@dataclass
class Forest:
    """Trees reduced to their roots: the nodes by round, and the roots that each round came to."""

    rounds: list[DataFrame]
    tops: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tops)


def ascend(nodes: DataFrame, name: str) -> Forest:
    """nodes: t (tree), i (place in it), size (nodes of the tree), start (nodes of earlier trees), digest, and more that stays with the first round."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    forest = Forest([], [])
    while most:
        forest.rounds.append(nodes)
        packed = nodes.select("t", "i", "size", "start", "digest", _group())
        up = written(packed.groupBy("pack").applyInPandas(_collapsed, _NODE), f"{name}-{len(forest.rounds)}")
        forest.tops.append(up.where("size = 1"))
        nodes, most = up.where("size > 1"), (-(-most // _BLOCK) if most > _BLOCK else 0)
    return forest


def descend(forest: Forest, above: DataFrame, carry: list[str]) -> DataFrame:
    """Path, subroot and root of every node of the first round, with its columns `carry`; above: t, path, subroot, root of each tree."""
    ends = ("path", "subroot", "root")
    down = None
    for k in reversed(range(len(forest.rounds))):
        keep = carry if k == 0 else ["below"]
        nodes = forest.rounds[k]
        tops = forest.tops[k].select("t", "i", "below").join(above, "t").select("t", "i", "below", *ends)
        upper = tops if down is None else tops.unionByName(down)
        types = dict(nodes.dtypes)
        schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["t long", "i long", *[f"{c} string" for c in ends]])
        left = nodes.select("t", "i", "size", "digest", *[c for c in keep if c != "digest"], _group()).groupBy("pack")
        down = left.cogroup(upper.groupBy("below")).applyInArrow(lean(_extended(keep)), schema)
    return down


def _extended(keep: list[str]):
    """(nodes, roots of their blocks) to nodes with their paths: lower proof, then upper proof."""

    def extended(nodes: pa.Table, upper: pa.Table) -> pa.Table:
        nodes = nodes.sort_by([("t", "ascending"), ("i", "ascending")])
        t, i, size = (nodes.column(c).to_numpy() for c in ("t", "i", "size"))
        digest = nodes.column("digest").to_pylist()
        known = {(r["t"], r["i"]): r for r in upper.to_pylist()}
        path, subroot, root = [], [], []
        for a, b in _blocks(t, i):
            r = known[t[a], i[a] // _BLOCK]
            own = _paths(_levels(digest[a:b], size[a] <= _BLOCK))
            path += [x + STEP + r["path"] if x and r["path"] else x or r["path"] for x in own]
            subroot += [r["subroot"]] * (b - a)
            root += [r["root"]] * (b - a)
        return nodes.select([*keep, "t", "i"]).append_column("path", pa.array(path, pa.string())).append_column("subroot", pa.array(subroot, pa.string())).append_column("root", pa.array(root, pa.string()))

    return extended


@dataclass
class Manifest:
    """lower: a tree for each source; upper: the one tree over their roots."""

    lower: Forest
    upper: Forest
    carry: list[str]

    @property
    def root(self) -> DataFrame:
        """One row, the root; none for an empty table."""
        return self.upper.roots.select(F.col("digest").alias("root"))


def manifest(docs: DataFrame, others: dict[str, Column] | None = None) -> Manifest:
    """others: more columns, of docs, that proofs() gives back beside doc_id and leaf."""
    others = others or {}
    leaves = docs.select("doc_id", group_key(F.col("source")).alias("key"), digest_of(*map(F.col, FIELDS)).alias("digest"), *[c.alias(n) for n, c in others.items()])
    placed = ranked(leaves, "key", ["doc_id", "digest"], "merkle-leaves")
    lower = ascend(placed.select("doc_id", "digest", *others, F.col("ordinal").cast("long").alias("t"), "i", "size", "start"), "merkle-lower")
    if not lower.tops:
        return Manifest(lower, Forest([], [placed.select("digest")]), [*others])
    subroots = lower.roots
    n = F.lit(subroots.count()).cast("long")
    nodes = subroots.select(F.lit(0).cast("long").alias("t"), F.col("t").alias("i"), n.alias("size"), F.lit(0).cast("long").alias("start"), "digest")
    return Manifest(lower, ascend(nodes, "merkle-upper"), [*others])


def proofs(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, path, and the manifest's other columns: a row for each row of the table."""
    if not m.lower.rounds:
        empty = m.upper.tops[0].sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, path string")
        return empty.withColumns({c: F.lit(None).cast("string") for c in m.carry})
    top = m.upper.roots.select("t", F.lit("").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    above = descend(m.upper, top, ["digest"]).select(F.col("i").alias("t"), "path", F.col("digest").alias("subroot"), "root")
    down = descend(m.lower, above, ["doc_id", "digest", *m.carry])
    return down.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", *m.carry)


def tampered(docs: DataFrame) -> Column:
    """Leaf of the row after its tampering; null where it is left alone."""
    fields = [lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, digest_of(*fields))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: every row's proof, and the root that its tampered leaf gives with it."""
    found = proofs(manifest(docs, {"other": tampered(docs)}))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """Plain version over (doc_id, source, lang, n_chars, text)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda row: _hash("".join(map(part, row)))
    first = lambda v: (v is not None, v if v is not None else 0)

    def tree(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
        """Root, and of each node the (left, right) siblings by level."""
        at, sides = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            for k, p in enumerate(at):
                lo = p - p % FANOUT
                sides[k].append((nodes[lo:p], nodes[p + 1 : lo + FANOUT]))
                at[k] = p // FANOUT
            nodes = [_hash("".join(nodes[k : k + FANOUT])) for k in range(0, len(nodes), FANOUT)]
        return nodes[0], sides

    groups: dict = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), first(r[0]), leaf(r))):
        groups.setdefault(r[1], []).append(r)
    trees = [tree([leaf(r) for r in g]) for g in groups.values()]
    if not trees:
        return []
    root, upper = tree([t[0] for t in trees])
    out = []
    for (subroot, lower), g, up in zip(trees, groups.values(), upper):
        for r, low in zip(g, lower):
            low = low + up
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], r[4].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))))
            else:
                node = leaf(r)
            for left, right in low:
                node = _hash("".join(left) + node + "".join(right))
            out.append((r[0], leaf(r), subroot, root, _hash("".join(x for a, b in low for x in a + b)), node, node == root))
    return out


def crc32_sql(x: str) -> str:
    """crc32 of an ASCII string; DuckDB has none."""
    bit = "list_reduce(list_prepend({}, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
    codes = f"list_transform(regexp_extract_all({x}, '(?s).'), lambda ch: ord(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda crc, b: xor({bit.format('xor(crc, b) & 255')}, crc >> 8)), 4294967295)"


_PART = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LEAF_SQL = "sha256(" + " || ".join(map(_PART, FIELDS)) + ")"
_LOWER_SQL = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

#: Nodes of all levels, then each leaf's runs with a hole in its own place.
ORACLE_SQL = f"""WITH RECURSIVE base AS (SELECT doc_id, coalesce('=' || source, '-') AS s, {_LEAF_SQL} AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN {_LEAF_SQL.replace(_PART("text"), _PART(_LOWER_SQL))} END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM base),
low AS (SELECT s, i, 0 AS lvl, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM leaves
  UNION ALL SELECT s, i // 16, lvl + 1, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM low WHERE n > 1 GROUP BY s, i // 16, lvl, n),
sub AS (SELECT s, h AS subroot, row_number() OVER (ORDER BY s) - 1 AS i FROM low WHERE n = 1),
up AS (SELECT i, 0 AS lvl, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT i // 16, lvl + 1, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY i // 16, lvl, n),
runs AS (SELECT l.s, l.i, r.lvl, string_agg(CASE WHEN r.i = l.i // power(16, r.lvl)::BIGINT THEN '.' ELSE r.h END, '' ORDER BY r.i) AS run FROM leaves l JOIN low r ON r.s = l.s AND r.n > 1 AND r.i // 16 = l.i // power(16, r.lvl + 1)::BIGINT GROUP BY ALL
  UNION ALL SELECT l.s, l.i, 100 + r.lvl, string_agg(CASE WHEN r.i = sub.i // power(16, r.lvl)::BIGINT THEN '.' ELSE r.h END, '' ORDER BY r.i) FROM leaves l JOIN sub ON sub.s = l.s JOIN up r ON r.n > 1 AND r.i // 16 = sub.i // power(16, r.lvl + 1)::BIGINT GROUP BY ALL),
paths AS (SELECT s, i, list(run ORDER BY lvl) AS path FROM runs GROUP BY s, i),
found AS (SELECT doc_id, leaf, subroot, (SELECT h FROM up WHERE n = 1) AS root, coalesce(path, []) AS path, coalesce(other, leaf) AS start FROM leaves JOIN sub USING (s) LEFT JOIN paths ON paths.s = leaves.s AND paths.i = leaves.i),
done AS (SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '.', '')) AS proof_sha256, list_reduce(list_prepend(start, path), lambda h, run: sha256(replace(run, '.', h))) AS folded_root FROM found)
SELECT *, folded_root = root AS verified FROM done"""
