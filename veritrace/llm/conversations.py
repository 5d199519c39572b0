"""Repair of a conversation's structure by the cheapest edits, and what is wrong with it.

Positions between turns times the four states of the grammar `(s?(ua)+)?` are the nodes of a graph; keeping, re-roling,
deleting and inserting a turn are its arcs. Forward and backward minimum costs tell which arcs are tight,
that is, lie on a cheapest path; a walk over the frontier of nodes takes the least edit letter that a tight arc has.

A conversation of any length is cut into blocks of BLOCK turns. A block's costs from each state to each state
are a 4 x 4 matrix; the matrices of a conversation are combined in order, forwards and backwards, in a stream that
holds one row at a time; with the costs at its borders each block is walked by itself.

Odd inputs: null role or text is one space; a null conv_id is a conversation; turns are taken by turn (null first),
then role, then a digest of role and text, so ties have an order; a role is known by its first character,
an empty one by none, which no place of the grammar takes; empty tables give none; very long texts are taken whole;
columns besides the four are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, written
from .merkle import crc32_sql
from .ranking import group_key, ranked

#: Turns of a block.
BLOCK = 512
#: Turns that a call gets, besides its last block: short conversations share a call.
_PACK = 2048
_WHITE = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60
DELETE, RETOLD, INSERT, CUT = 2, 1, 5, 5

#: States: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's; 0 and 3 may end.
_TAKES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state that a turn of the right one of user and assistant leads to.
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_ENDS = (0, 3)
_LEGAL = ("su", "ua", "au")


# --- costs within a block


def _inserted(f: list[int]) -> list[int]:
    """Costs from the left with insertions."""
    two = min(f[2], f[0] + INSERT, f[1] + INSERT, f[3] + INSERT)
    return [f[0], f[1], two, min(f[3], two + INSERT)]


def _insertable(b: list[int]) -> list[int]:
    """Costs to the end with insertions."""
    two = min(b[2], b[3] + INSERT)
    return [min(b[0], two + INSERT), min(b[1], two + INSERT), two, min(b[3], two + INSERT)]


#: At the end of a conversation.
_LAST = _insertable([0, _NEVER, _NEVER, 0])
_FIRST = _inserted([0, _NEVER, _NEVER, _NEVER])


def _arcs(q: int, turn: tuple) -> list[tuple[str, int, int]]:
    """(letter, state, cost) of the edits of a turn, in the letters' order."""
    initial, dead, cut = turn
    out = [("D", q, DELETE)]
    if not dead:
        if initial in _TAKES[q]:
            out.append(("K", _TAKES[q][initial], CUT * cut))
        out.append(("R", _NEXT[q], RETOLD + CUT * cut))
    return out


def _forward(turns: list[tuple], f: list[int]) -> list[list[int]]:
    out = [_inserted(f)]
    for turn in turns:
        f, g = out[-1], [_NEVER] * 4
        for q in range(4):
            if f[q] < _NEVER:
                for _, to, cost in _arcs(q, turn):
                    g[to] = min(g[to], f[q] + cost)
        out.append(_inserted(g))
    return out


def _backward(turns: list[tuple], b: list[int]) -> list[list[int]]:
    out = [b]
    for turn in reversed(turns):
        out.append(_insertable([min(out[-1][to] + cost for _, to, cost in _arcs(q, turn)) for q in range(4)]))
    return out[::-1]


def _walk(turns: list[tuple], f: list[list[int]], b: list[list[int]], best: int, frontier: set[int], last: bool) -> tuple[list[tuple[str, int, int]], set[int]]:
    """Edits (letter, turn, state reached) of the least cheapest audit from the frontier on, and the frontier behind the block."""
    j, edits = 0, []
    while True:
        if j == len(turns) and (not last or any(q in _ENDS and f[j][q] == best for q in frontier)):
            return edits, frontier
        found: dict[str, set[int]] = {}
        for q in frontier:
            if j < len(turns):
                for letter, to, cost in _arcs(q, turns[j]):
                    if f[j][q] + cost + b[j + 1][to] == best:
                        found.setdefault(letter, set()).add(to)
            if f[j][q] + INSERT + b[j][_NEXT[q]] == best:
                found.setdefault("I", set()).add(_NEXT[q])
        letter = min(found)
        frontier = found[letter]
        # a state and a letter lead to one state, so paths of one audit never part: the frontier names the role
        edits.append((letter, -1 if letter == "I" else j, min(frontier)))
        j += letter != "I"


# --- turns and their faults


def _crc(*columns: str) -> Column:
    return F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in columns]))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: conv_id, turn, role, text."""
    kind = F.col("_kind")
    text = F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", "role", "text", (_crc("conv_id", "turn") % 20).alias("_kind")).where(kind != 0)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), copies.alias("_copy"))
    return out.drop("_copy")


def _placed(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    mark = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = rows.select(group_key(F.col("conv_id")).alias("key"), "conv_id", "turn", role.alias("role"), text.alias("text"), mark.alias("mark"))
    out = ranked(rows, "key", ["turn", "role", "mark"], "turns").withColumn("block", F.expr(f"i div {BLOCK}"))
    return out.withColumn("pack", F.expr(f"(start + block * {BLOCK}) div {_PACK}"))


class _Block:
    """Turns of one block with their faults. seen: marks of earlier blocks."""

    def __init__(self, rows: dict[str, list], a: int, b: int, seen: set[str]):
        self.role, self.text, self.turn = rows["role"][a:b], rows["text"][a:b], rows["turn"][a:b]
        self.conv_id, self.key, self.block, self.size = rows["conv_id"][a], rows["key"][a], rows["block"][a], rows["size"][a]
        self.turns, self.blank, self.duplicate, self.truncated = [], 0, 0, 0
        seen = set(seen)
        for role, text, mark in zip(self.role, self.text, rows["mark"][a:b]):
            end = text.rstrip(_WHITE)[-1:]
            blank, duplicate = not end, mark in seen
            cut = not blank and not duplicate and end not in ".!?"
            seen.add(mark)
            self.blank += blank
            self.duplicate += duplicate and not blank
            self.truncated += cut
            self.turns.append((role[:1], blank or duplicate, cut))

    @property
    def last(self) -> bool:
        return self.block == (self.size - 1) // BLOCK

    def solved(self, border: dict | None) -> tuple[list, int]:
        """Edits, and the state behind the block. border: costs and state at its ends; none where the block is all."""
        border = border or {"f": _FIRST, "b": _LAST, "entry": 0}
        f, b = _forward(self.turns, border["f"]), _backward(self.turns, border["b"])
        best = min(x + y for x, y in zip(f[0], b[0]))
        edits, frontier = _walk(self.turns, f, b, best, {border["entry"]}, self.last)
        return edits, min(frontier)

    def repaired(self, edits: list) -> list[tuple[str, str, str]]:
        """(letter, role, text) for each edit."""
        return [(e, self.role[j] if e in "KD" else _ROLE[q], "" if e == "I" else self.text[j]) for e, j, q in edits]


def _sorted_blocks(t: pa.Table, borders: pa.Table | None):
    """A _Block and its border for each block of a group."""
    t = t.sort_by([("key", "ascending"), ("i", "ascending")])
    rows = {c: t.column(c).to_pylist() for c in t.column_names}
    known = {(r["key"], r["block"]): r for r in borders.to_pylist()} if borders is not None else {}
    at = [k for k in range(t.num_rows) if not k or (rows["key"][k], rows["block"][k]) != (rows["key"][k - 1], rows["block"][k - 1])]
    for a, b in zip(at, [*at[1:], t.num_rows]):
        border = known.get((rows["key"][a], rows["block"][a]))
        yield _Block(rows, a, b, (border and border["seen"]) or ()), border


def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [pa.field(*(lambda n, t: (n, types[t]))(*c.split())) for c in schema.split(", ")]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(fields), fields)], schema=pa.schema(fields))


def _by_block(rows: DataFrame, borders: DataFrame | None, f, schema: str) -> DataFrame:
    """f(block, border), a list of rows, over all blocks."""

    def alone(t: pa.Table) -> pa.Table:
        return _table([r for x in _sorted_blocks(t, None) for r in f(*x)], schema)

    def together(t: pa.Table, known: pa.Table) -> pa.Table:
        return _table([r for x in _sorted_blocks(t, known) for r in f(*x)], schema)

    if borders is None:
        return rows.groupBy("pack").applyInArrow(lean(alone), schema)
    return rows.groupBy("pack").cogroup(borders.groupBy("pack")).applyInArrow(lean(together), schema)


def _in_order(blocks: DataFrame, f, schema: str, backwards: bool = False) -> DataFrame:
    """f over each conversation's blocks in their order, as a stream: f(row, state or None) gives (output row or None, state); a conversation's last state is f's own affair."""

    def stream(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    key, state = row["key"], None
                said, state = f(row, state)
                if said is not None:
                    out.append(said)
            if out:
                yield from _table(out, schema).to_batches()

    order = F.desc("block") if backwards else F.asc("block")
    return blocks.repartition("key").sortWithinPartitions("key", order).mapInArrow(lean(stream), schema)


# --- conversations of several blocks


def _matrix(block: _Block, border: dict | None) -> list[tuple]:
    out = []
    for q in range(4):
        out += _forward(block.turns, [0 if p == q else _NEVER for p in range(4)])[-1]
    return [(block.key, block.block, int(block.last), out)]


def _from_left(row: dict, f: list[int] | None):
    f = f or _FIRST
    m = row["matrix"]
    return (row["key"], row["block"], row["last"], m, f), [min(f[p] + m[4 * p + q] for p in range(4)) for q in range(4)]


def _from_right(row: dict, b: list[int] | None):
    b = b or _LAST
    m = row["matrix"]
    return (row["key"], row["block"], row["f"], b), [min(m[4 * q + p] + b[p] for p in range(4)) for q in range(4)]


def _exits(block: _Block, border: dict) -> list[tuple]:
    """The state behind the block for each state before it that a cheapest path may have."""
    f, b = _forward(block.turns, border["f"]), _backward(block.turns, border["b"])
    best = min(x + y for x, y in zip(f[0], b[0]))
    out = [min(_walk(block.turns, f, b, best, {q}, block.last)[1]) if f[0][q] + b[0][q] == best else -1 for q in range(4)]
    return [(block.key, block.block, out)]


def _entered(row: dict, q: int | None):
    q = q or 0
    return (row["key"], row["block"], q), row["exits"][q]


def _borders(rows: DataFrame) -> DataFrame:
    """For each block of the given conversations: marks seen in earlier blocks, costs and state at its ends."""
    first = F.min("block").over(W.partitionBy("key", "mark"))
    seen = rows.select("key", "block", "pack", "mark").distinct().withColumn("first", first)
    seen = seen.groupBy("key", "block", "pack").agg(F.collect_list(F.when(F.col("block") > F.col("first"), F.col("mark"))).alias("seen"))
    seen = written(seen, "turns-seen")
    at = ["key", "block"]
    left = _in_order(_by_block(rows, seen, _matrix, "key string, block long, last int, matrix array<long>"), _from_left, "key string, block long, last int, matrix array<long>, f array<long>")
    costs = _in_order(written(left, "turns-left"), _from_right, "key string, block long, f array<long>, b array<long>", backwards=True)
    known = seen.join(written(costs, "turns-costs"), at)
    entries = _in_order(_by_block(rows, known, _exits, "key string, block long, exits array<int>"), _entered, "key string, block long, entry int")
    return known.join(written(entries, "turns-entries"), at)


# --- results

_DIGEST = "key string, block long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first string, last string, cost long, audit string, body string"
_REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COST = {"D": DELETE, "K": 0, "R": RETOLD, "I": INSERT}


def _digested(block: _Block, border: dict | None) -> list[tuple]:
    edits, _ = block.solved(border)
    cost = sum(_COST[e] + (CUT if e in "KR" and block.turns[j][2] else 0) for e, j, _ in edits)
    initials = [t[0] for t in block.turns]
    turns = sorted({t for t in block.turn if t is not None})
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
    body = "\n".join(f"{role}:{text}" for e, role, text in block.repaired(edits) if e != "D")
    ends = (turns[0], turns[-1]) if turns else (None, None)
    return [(block.key, block.block, block.blank, block.duplicate, block.truncated, illegal, len(turns), *ends, initials[0], initials[-1], cost, "".join(e for e, _, _ in edits), body)]


def _assembled(sized: DataFrame) -> DataFrame:
    """One row for each conversation from its blocks, in their order; the digest of the repaired text is fed block by block."""

    def stream(batches):
        state = None

        def done():
            turns = (state["last_turn"] - state["first_turn"] + 1 - state["turns"]) if state["turns"] else 0
            return (state["key"], turns, *(state[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(state["audits"]), state["hash"].hexdigest())

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if state is None or r["key"] != state["key"]:
                    if state is not None:
                        out.append(done())
                    state = r | {"audits": [], "hash": hashlib.sha256(), "any": False}
                else:
                    for c in ("blank", "duplicate", "truncated", "cost"):
                        state[c] += r[c]
                    state["illegal"] += r["illegal"] + (state["last"] + r["first"] not in _LEGAL)
                    state["turns"] += r["turns"] - (r["turns"] > 0 and r["first_turn"] == state["last_turn"])
                    state["last"] = r["last"]
                    state["last_turn"] = r["last_turn"] if r["turns"] else state["last_turn"]
                    state["first_turn"] = r["first_turn"] if state["first_turn"] is None else state["first_turn"]
                state["audits"].append(r["audit"])
                if r["body"]:
                    state["hash"].update((("\n" if state["any"] else "") + r["body"]).encode())
                    state["any"] = True
            if out:
                yield from _table(out, _REPORT).to_batches()
        if state is not None:
            yield from _table([done()], _REPORT).to_batches()

    return sized.repartition("key").sortWithinPartitions("key", "block").mapInArrow(lean(stream), _REPORT)


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Turns of conversations of one block, and those of several with their borders, if there are any."""
    placed = _placed(rows)
    if (placed.agg(F.max("size")).first()[0] or 0) <= BLOCK:
        return placed, None, None
    long_ = placed.where(F.col("size") > BLOCK)
    return placed.where(F.col("size") <= BLOCK), long_, written(_borders(long_), "turns-borders")


def reports(rows: DataFrame) -> DataFrame:
    """key (of conv_id), faults, cost, audit and digest of the repaired text of each conversation that has turns."""
    short, long_, borders = _parts(rows)
    one = _by_block(short, None, _digested, _DIGEST)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    out = one.select("key", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("body", 256).alias("repaired_sha256"))
    return out if long_ is None else out.unionByName(_assembled(_by_block(long_, borders, _digested, _DIGEST)))


def repaired(rows: DataFrame) -> DataFrame:
    """The edits: conv_id, block, place (of the edit in its block), edit, role, text; deleted turns are among them."""

    def edited(block: _Block, border: dict | None) -> list[tuple]:
        return [(block.key, block.block, k, *x) for k, x in enumerate(block.repaired(block.solved(border)[0]))]

    schema = "key string, block long, place long, edit string, role string, text string"
    short, long_, borders = _parts(rows)
    out = _by_block(short, None, edited, schema)
    if long_ is not None:
        out = out.unionByName(_by_block(long_, borders, edited, schema))
    conv_id = F.when(F.col("key") == "-", None).otherwise(F.substring("key", 2, 1 << 30)).cast(dict(rows.dtypes)["conv_id"])
    return out.select(conv_id.alias("conv_id"), "block", "place", "edit", "role", "text")


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns, for every conversation, those without turns left included."""
    every = conversations.select("conv_id").distinct().withColumn("key", group_key(F.col("conv_id")))
    found = every.join(reports(damaged(conversations)), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


# --- plain versions


def damaged_plain(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_force(rows: list[tuple]) -> tuple:
    """Plain version over one conversation's (turn, role, text) in order: cheapest audits by a search over all edits, least first."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(_WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    states = {(0, ""): (0, "", ())}  # (turns taken, initials so far collapsed): cost, audit, output
    best = None
    todo = [(0, "", 0, "", ())]
    known: dict = {}
    import heapq

    while todo:
        cost, audit, j, said, out = heapq.heappop(todo)
        end = said[-2:] if len(said) > 1 else said
        if (j, end, bool(said)) in known:
            continue
        known[j, end, bool(said)] = True
        if j == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            best = (cost, audit, out)
            break
        moves = []
        if j < len(rows):
            moves.append((DELETE, "D", None, None))
            if faults[j] not in ("blank", "duplicate"):
                add = CUT * (faults[j] == "truncated")
                moves.append((add, "K", rows[j][1], rows[j][2]))
                moves += [(RETOLD + add, "R", x, rows[j][2]) for x in ("user", "assistant")]
        moves += [(INSERT, "I", x, "") for x in ("user", "assistant")]
        for c, e, role, text in moves:
            grown = said if role is None else said + (role[:1] or "?")
            if role is None or re.fullmatch("s?(ua)*u?", grown):
                heapq.heappush(todo, (cost + c, audit + e, j + (e != "I"), grown, out if role is None else (*out, f"{role}:{text}")))
    turns = {r[0] for r in rows if r[0] is not None}
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


_SPACE = r"[\x20\x09-\x0D]"
#: Costs and audits by a recursion over turns; each step keeps the least of a state's (cost, audit).
ORACLE_SQL = f"""WITH RECURSIVE k AS (SELECT coalesce('=' || conv_id, '-') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY key) AS n, left(role, 1) AS c, left(lag(role) OVER w, 1) || left(role, 1) AS pair, sha256(strlen(role) || ':' || role || text) AS mark, regexp_replace(text, '{_SPACE}+$', '') AS body FROM d WINDOW w AS (PARTITION BY key ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text))),
f AS (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY key, mark ORDER BY j) > 1 AS dup FROM o),
t AS (SELECT *, NOT blank AND NOT dup AND right(body, 1) NOT IN ('.', '!', '?') AS cut, blank OR dup AS dead FROM f),
grow(q, c, nxt, who) AS (VALUES (0, 's', 2, 'user'), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
ins(q, q2, fee, word, said) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
arcs(q, edit, c, q2, who) AS (SELECT q, 'D', NULL::VARCHAR, q, NULL::VARCHAR FROM (VALUES (0), (1), (2), (3)) v(q) UNION ALL SELECT q, 'K', c, CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, NULL::VARCHAR FROM grow UNION ALL SELECT DISTINCT q, 'R', NULL::VARCHAR, nxt, who FROM grow),
dp AS (SELECT key, 0 AS j, q2 AS q, {{'cost': fee, 'audit': word, 'said': said}} AS way FROM (SELECT DISTINCT key FROM t), ins WHERE ins.q = 0
  UNION ALL SELECT key, j + 1, q2, min({{'cost': cost, 'audit': audit, 'said': said}}) FROM (
    SELECT dp.key, dp.j, ins.q2, way.cost + ins.fee + CASE edit WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END + CASE WHEN cut AND edit <> 'D' THEN 5 ELSE 0 END AS cost, way.audit || edit || ins.word AS audit,
      list_concat(way.said, CASE WHEN edit = 'D' THEN []::VARCHAR[] ELSE [coalesce(arcs.who, t.role) || ':' || t.text] END, ins.said) AS said
    FROM dp JOIN t ON t.key = dp.key AND t.j = dp.j JOIN arcs ON arcs.q = dp.q AND (edit = 'D' OR NOT dead) AND (arcs.c IS NULL OR arcs.c = t.c) JOIN ins ON ins.q = arcs.q2) GROUP BY key, j, q2),
best AS (SELECT dp.key, min(way) AS way FROM dp JOIN (SELECT DISTINCT key, n FROM t) e ON e.key = dp.key AND e.n = dp.j WHERE q IN (0, 3) GROUP BY dp.key),
facts AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE j > 0 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY key)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '-') AS key FROM conversations) LEFT JOIN facts USING (key) LEFT JOIN best USING (key)"""
