"""Operators on lines, manifests and conversations against plain versions, and on odd inputs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrace.llm import conversations, lines, merkle
from veritrace.llm.ranking import ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, shard int, digest string, start long, i long, pack int, change int"


def docs_of(spark, rows, schema=DOCS):
    """rows: (doc_id, source, text); further columns have names that the operators use."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1, "y", 2, 3, 4, 5) for i, s, t in rows], schema)


def odd_docs():
    r = random.Random(5)
    shared = ["This line is the footer of many pages.", "  Subscribe to our NEWSLETTER today!\t", "Ünïcode überall in dieser Zeile, wirklich", "short line", "x" * 19, "y" * 20]
    out = [(None, None, None), (0, "", ""), (1, "a", "\n\n"), (2, "a", "one line of more than twenty"), (3, None, "b" * 300_000 + "\n" + shared[0])]
    for k in range(4, 60):
        body = [r.choice(shared) for _ in range(r.randrange(4))] + [f"own line number {k} of this very text"] + [r.choice(shared).lower() for _ in range(r.randrange(3))]
        out.append((k, r.choice(["a", "b", "é", None]), "\n".join(body)))
    return out + [out[-1], out[-1], (59, "b", shared[1] + "\nanother text of document fifty-nine"), (None, "a", "\n".join(shared)), (None, "b", shared[0])]


# --- ranks


def test_ranked(spark):
    r = random.Random(2)
    rows = [(r.choice("aabbbbbbc"), r.randrange(50)) for _ in range(700)]
    got = ranked(spark.createDataFrame(rows, "k string, v int").repartition(5), "k", ["v"], "test").collect()
    want = sorted(rows)
    for ordinal, k in enumerate("abc"):
        own = sorted((x.i, x.v, x.size, x.start, x.ordinal) for x in got if x.k == k)
        start = next(n for n, x in enumerate(want) if x[0] == k)
        assert own == [(n, v, len(own), start, ordinal) for n, v in enumerate(v for q, v in want if q == k)]
    assert ranked(spark.createDataFrame([], "k string, v int"), "k", ["v"], "test").count() == 0


# --- 11: lines


def test_cuckoo_holds_exactly_what_is_in():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 30_000).astype(np.uint64) * np.uint64(2)
    f = lines.Cuckoo.sized(len(keys))
    f.insert(keys[:20_000])
    f.insert(keys[20_000:])
    assert f.has(keys).all()
    assert f.has(r.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.002
    f = lines.Cuckoo.read(f.slots.tobytes(), list(f.stash.elements()))
    f.delete(keys[10_000:])
    assert f.has(keys[:10_000]).all() and f.has(keys[10_000:]).mean() < 0.002
    f.delete(keys[:10_000])
    assert not f.slots.any() and not f.stash
    f.insert(np.full(40, keys[0]))  # more than the two buckets of a key hold
    assert f.has(keys[:1]).all() and f.stash
    f.delete(np.full(39, keys[0]))
    assert f.has(keys[:1]).all()
    f.delete(keys[:1])
    assert not f.has(keys[:1]).any() and not f.slots.any()


def cleaned(index, docs):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in index.cleaned(docs).collect()), key=repr)


def test_lines_against_plain(spark):
    rows = odd_docs()
    docs = docs_of(spark, rows)
    want = sorted(lines.brute_force([(i, t) for i, _, t in rows]), key=repr)
    assert cleaned(lines.LineIndex().inserted(docs), docs) == want
    assert any(x[2] for x in want)
    got = sorted((r.doc_id is None, r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.digest(docs).where("doc_id > 0").collect())
    import hashlib

    assert got == sorted((False, i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want if i)
    assert lines.digest(docs.where("false")).count() == 0


def test_lines_in_and_out(spark):
    """Any order of insertions and deletions gives what a new index of the documents that are left gives."""
    rows = odd_docs()
    plain = lambda keep: sorted(lines.brute_force([(i, t) for i, _, t in rows if keep(i)]), key=repr)
    docs = docs_of(spark, rows).cache()
    part = lambda sql: docs.where(sql)
    first = lines.LineIndex().inserted(part("doc_id % 3 = 0 OR doc_id IS NULL"))
    second = first.inserted(part("doc_id % 3 > 0 OR doc_id = 9"))  # 9 is in already
    assert cleaned(second, docs) == plain(lambda i: True)
    third = second.deleted(part("doc_id > 40 OR doc_id IS NULL"))
    assert cleaned(third, part("doc_id <= 40")) == plain(lambda i: i is not None and i <= 40)
    assert cleaned(third.inserted(part("doc_id > 40 OR doc_id IS NULL")), docs) == plain(lambda i: True)
    assert cleaned(first, part("doc_id % 3 = 0 OR doc_id IS NULL")) == plain(lambda i: i is None or i % 3 == 0)  # an earlier state still stands
    none = third.deleted(docs)
    assert none.counts.count() == 0 and none.held().count() == 0 and none.filters.agg(F.sum("keys")).first()[0] == 0
    assert none.deleted(docs).counts.count() == 0


def test_line_filters_are_made_anew_when_full(spark, monkeypatch):
    text = lambda n: "\n".join(f"a line that is shared, number {k}" for k in range(n))
    index = lines.LineIndex().inserted(docs_of(spark, [(k, "a", text(20)) for k in range(3)]))
    before = index.filters.count()
    docs = docs_of(spark, [(k, "a", text(3000)) for k in range(10, 14)])
    index = index.inserted(docs)
    assert {r.n_dropped for r in index.cleaned(docs).collect()} == {3000, 0} and before <= index.shards
    assert index.filters.agg(F.sum("keys")).first()[0] == 3000
    monkeypatch.setattr(lines, "SHARD_KEYS", 20)
    grown = index.inserted(docs_of(spark, [(99, "a", "one line more to change the index")]))
    assert grown.shards > index.shards and {r.n_dropped for r in grown.cleaned(docs).collect()} == {3000, 0}


# --- 12: manifest


def manifest_rows(rows):
    return [(i, s, "en", None if t is None else len(t), t) for i, s, t in rows]


@pytest.mark.parametrize("sizes", [(1,), (16, 1), (17, 256, 2), (257, 3, 1), (4097, 300)])
def test_manifest_against_plain(spark, sizes):
    rows = [(k, f"s{n}", f"Text {k} of {n}") for n, size in enumerate(sizes) for k in range(size)]
    got = sorted(map(tuple, merkle.digest(docs_of(spark, rows)).collect()))
    assert got == sorted(merkle.brute_force(manifest_rows(rows)))
    assert {v for *_, v in got} <= {True, False}
    if len(rows) > 100:
        assert {v for *_, v in got} == {True, False}


def test_manifest_of_many_small_sources(spark):
    rows = [(k, f"s{k % 700}", f"t{k}") for k in range(1500)]
    assert sorted(map(tuple, merkle.digest(docs_of(spark, rows)).collect())) == sorted(merkle.brute_force(manifest_rows(rows)))


def test_manifest_of_odd_rows(spark):
    rows = odd_docs()
    got = merkle.digest(docs_of(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, merkle.brute_force(manifest_rows(rows))))
    whole = merkle.manifest(docs_of(spark, rows))
    assert [r.root for r in whole.root.collect()] == [got[0].root]
    empty = merkle.manifest(docs_of(spark, []))
    assert merkle.proofs(empty).count() == 0 and merkle.digest(docs_of(spark, [])).count() == 0


def test_proofs_find_any_change(spark):
    rows = [(k, "a" if k % 3 else "b", f"text {k}") for k in range(90)]
    proofs = merkle.proofs(merkle.manifest(docs_of(spark, rows)))
    back = proofs.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("same"), (merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("other"))
    assert {tuple(r) for r in back.collect()} == {(True, False)}


# --- 13: conversations

TURNS = "conv_id long, turn long, role string, text string, key string, block int, mark string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "m") for r in rows], TURNS)


def expected(rows):
    """conv_id: report, from rows in any order."""
    mark = lambda role, text: merkle._hash(f"{len(role.encode())}:{role}{text}")
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), mark(r[1], r[2]))
    return {conv: conversations.brute_force(sorted(g, key=order)) for conv, g in groups.items()}


def report(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {(None if r.key == "-" else int(r.key[1:])): tuple(r[n] for n in names) for r in df.collect()}


def random_turns(r, convs, most):
    texts = ["Hello there.", "Why?", "No end", " ", "", "Yes!", "trailing. \n", None, "a.b"]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "unknown"]
    return [(c, r.choice([t, t, t + 1, None]), r.choice(roles), r.choice(texts)) for c in range(convs) for t in range(r.randrange(most))]


def test_conversations_against_a_search(spark):
    rows = random_turns(random.Random(7), 150, 9) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hi.")]
    got = report(conversations.reports(turns_of(spark, rows)))
    assert got == expected(rows)
    assert sum(x[5] > 0 for x in got.values()) > 50


def test_conversation_edits(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "What?"), (2, 0, "user", "No end"), (2, 1, "assistant", "Yes.")]
    edits = lambda c: [(r.edit, r.role, r.text) for r in conversations.repaired(turns_of(spark, rows)).where(f"conv_id = {c}").orderBy("block", "place").collect()]
    assert edits(1) == [("R", "user", "Hi."), ("R", "assistant", "What?")]
    assert edits(2) == [("D", "user", "No end"), ("D", "assistant", "Yes.")]


def test_long_conversations_come_out_as_in_one_block(spark):
    """Three blocks and more, with duplicates over the borders, against one block's walk."""
    r = random.Random(3)
    long_ = [(1, t, *r.choice([("user", f"q{t}."), ("assistant", f"a{t}."), ("user", f"cut {t}"), ("assistant", "Same."), ("user", "Same?"), ("system", f"s{t}.")])) for t in range(1700)]
    rows = long_ + random_turns(r, 1, 6) + [(2, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(conversations.BLOCK)] + [(3, t // 2, "user", "") for t in range(1100)]
    got = report(conversations.reports(turns_of(spark, rows)))
    for conv in (1, 2, 3):
        own = sorted((x[1:] for x in rows if x[0] == conv), key=lambda x: x[0])
        block = conversations._Block({"role": [x[1] for x in own], "text": [x[2] for x in own], "turn": [x[0] for x in own], "mark": [x[1:] for x in own], "conv_id": [conv] * len(own), "key": ["k"] * len(own), "block": [0] * len(own), "size": [1] * len(own)}, 0, len(own), set())
        (whole,) = conversations._digested(block, None)
        turns = {x[0] for x in own}
        want = (max(turns) - min(turns) + 1 - len(turns), *whole[2:6], whole[11], whole[12], merkle._hash(whole[13]))
        assert got[conv] == want
    edits = conversations.repaired(turns_of(spark, long_)).orderBy("block", "place").collect()
    assert "".join(x.edit for x in edits) == got[1][6]
    assert merkle._hash("\n".join(f"{x.role}:{x.text}" for x in edits if x.edit != "D")) == got[1][7]


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "Be. Good!"), ("user", "Hi?"), ("assistant", None), (None, "x.y")])] + [(None, None, "user", "a.")]
    got = Counter(map(tuple, conversations.damaged(turns_of(spark, rows)).collect()))
    assert got == Counter(conversations.damaged_plain(rows))
    out = {r.conv_id: r for r in conversations.digest(turns_of(spark, rows)).collect()}
    assert set(out) == {r[0] for r in rows}
    want = expected(conversations.damaged_plain(rows))
    assert all(tuple(out[c])[1:] == want.get(c, (0, 0, 0, 0, 0, 0, "", merkle._hash(""))) for c in out)


def test_a_conversation_without_turns_left(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (row,) = conversations.digest(turns_of(spark, [(lost, 0, "user", "Hi.")])).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", merkle._hash(""))
    assert conversations.digest(turns_of(spark, [])).count() == 0
    assert conversations.repaired(turns_of(spark, [])).count() == 0
