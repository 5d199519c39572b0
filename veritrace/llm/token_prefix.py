"""Exact token counts of every prefix of a text, by dynamic programming over its bytes.

For byte-level BPE the encoding of s[:i] ends in exactly one token t for which the pair
(last token of s[:i - len(t)], t) survives the merges. So the last token and the count of
every prefix follow from shorter prefixes, without encoding any of them. Texts fall into
units (a word with its leading space, a run of white space, ...) whose counts do not
depend on what surrounds them; the steps in count within a unit are kept, and a text's
counts are the running sum of its units' steps. Truncation and budget questions are
lookups in that sum.

Odd inputs. Null text is empty. Repeated rows get a row each; an empty table gives an empty
one; extra columns are not read. Time is linear in the text: units of any length, runs of
blanks too, are gone through once. A prefix ends at a code point. Counts can fall as a prefix grows
(a finished word may be one token), so `longest prefix within n tokens` is the last
prefix whose count is at most n.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

DEFAULT_FILE = "byte_bpe_50k.json"
#: Units of a worker's cache; a full cache becomes the old one, from which units in use come back.
CACHE_UNITS = 600_000
#: White space is Unicode's property, without the separators 0x1C-0x1F that Python's \\s takes in.
_W, _NOT = r"\p{White_Space}", r"[^\p{White_Space}\p{L}\p{N}]+"
_NEXT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?{_NOT}|{_W}+(?!\P{{White_Space}})|{_W}+"
#: Two or more white-space characters go with what follows them: that splits off the last one.
_UNIT = rf"{_W}+ (?:\p{{L}}+|\p{{N}}+|{_NOT})|{_W}{{2,}}(?:'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}+|{_NOT})?|{_NEXT}"
_BLANKS = regex.compile(rf"{_W}+")
_CONTRACTIONS = frozenset("'s 't 're 've 'm 'll 'd".split())
_SIMPLE = regex.compile(rf" ?(?:\p{{L}}+|\p{{N}}+|{_NOT})|{_W}")


def tokenizer_path(file: str = DEFAULT_FILE) -> str:
    if "/" in file:
        return file
    import public_tokenizers

    return public_tokenizers.path(file)


def _byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_chars()
        vocab = spec["model"]["vocab"]
        raw = lambda t: bytes(byte[c] for c in t)
        self.special = [t["content"] for t in spec["added_tokens"]]
        names = {t: i for t, i in vocab.items() if t not in self.special}
        self.ids = {raw(t): i for t, i in names.items()}
        self.longest = max(map(len, self.ids))
        #: lengths of the tokens that end in two bytes, longest first
        self.tails: dict[bytes, list[int]] = {}
        for n, tail in sorted({(len(t), t[-2:]) for t in self.ids if len(t) > 1}, reverse=True):
            self.tails.setdefault(tail, []).append(n)
        self.pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {i: (i, i) for i in names.values()}
        self.rank: dict[int, int] = {i: 0 for i in names.values()}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = names[a], names[b], names[a + b]
            self.pair[x, y] = z
            if self.parts[z] == (z, z):
                self.parts[z] = (x, y)
                self.rank[z] = k + 1
        self.agree: dict[tuple[int, int], bool] = {}
        self.units: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}
        self._find = regex.compile(_UNIT).findall
        self._pieces = regex.compile(_NEXT).findall
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _stay(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens are what the merges leave: going back through the merges that
        made them, latest first, no pair at their border would have been merged before."""
        key = (left, right)
        if (known := self.agree.get(key)) is not None:
            return known
        rank, parts, pair = self.rank, self.parts, self.pair
        a, b, bound = left, right, len(rank) + 1
        out = True
        while True:
            z = pair.get((a, b))
            if z is not None and rank[z] < bound:
                out = False
                break
            # undo the later of the two merges; at equal ranks the left one happened first
            ra, rb = rank[a], rank[b]
            if not ra and not rb:
                break
            if ra > rb:
                bound, a = ra, parts[a][1]
            else:
                bound, b = rb + 1, parts[b][0]
        self.agree[key] = out
        return out

    def byte_counts(self, s: bytes) -> list[int]:
        """Tokens of s[:i] for i in 0..len(s), for one piece."""
        n, get, longest = len(s), self.ids.get, self.longest
        agree, stay, tails = self.agree.get, self._stay, self.tails.get
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            # in a long piece only lengths that a token with these last two bytes can have are tried
            at = range(i - longest if i > longest else 0, i) if i < 24 else [i - k for k in (*tails(s[i - 2 : i], ()), 1) if k <= i]
            for j in at:
                t = get(s[j:i])
                if t is not None:
                    if j:
                        key = (last[j], t)
                        known = agree(key)
                        if not (stay(*key) if known is None else known):
                            continue
                    last[i], count[i] = t, count[j] + 1
                    break
            else:
                raise ValueError("no encoding: the vocabulary lacks a byte")
        return count

    def _total(self, text: str) -> int:
        return sum(self.byte_counts(p.encode())[-1] for p in self._pieces(text))

    def _counts(self, piece: str) -> list[int]:
        """Tokens at each code point of one piece, whose prefixes are pieces too."""
        raw = piece.encode()
        counts = self.byte_counts(raw)
        if len(raw) == len(piece):
            return counts
        return [0, *(counts[k] for k in range(1, len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80)]

    def steps(self, unit: str) -> bytes:
        """Change of the count at each code point of a unit, as int8; in time that is linear in its length.

        A run of white space is one piece while nothing follows; what follows takes its last
        character off: a blank as part of the next piece, any other as a piece of its own.
        """
        if _SIMPLE.fullmatch(unit):
            counts = self._counts(unit)
        elif blanks := _BLANKS.match(unit):
            m = blanks.end()
            run, rest = self._counts(unit[:m]), unit[m:]
            counts = run
            if rest in _CONTRACTIONS and unit[m - 1] != " ":
                ahead = run[m - 1] + self._total(unit[m - 1])
                counts = run + [ahead + self._total(rest[:k]) for k in range(1, len(rest) + 1)]
            elif rest and unit[m - 1] == " ":
                counts = run + [run[m - 1] + k for k in self._counts(unit[m - 1 :])[2:]]
            elif rest:
                ahead = run[m - 1] + self._total(unit[m - 1])
                counts = run + [ahead + k for k in self._counts(rest)[1:]]
        else:  # a contraction
            counts = [self._total(unit[:k]) for k in range(len(unit) + 1)]
        return np.diff(np.array(counts, np.int64)).astype(np.int8).tobytes()

    def _of(self, unit: str) -> bytes:
        got = self.units.get(unit)
        if got is None:
            if len(self.units) >= CACHE_UNITS:
                self.old_units, self.units = self.units, {}
                if len(self.agree) > 4 * CACHE_UNITS:
                    self.agree.clear()
            got = self.old_units.get(unit)
            if got is None:
                got = self.steps(unit)
            if len(unit) <= 64:
                self.units[unit] = got
        return got

    def text_steps(self, text: str) -> np.ndarray:
        """Change of the count at each code point of the text."""
        if self._special is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for k, part in enumerate(self._special.split(text)):
            if k % 2 == 0:
                before, segment = part, self._plain(part)
                out.append(segment)
            else:  # an unfinished special string is ordinary text, a finished one is one token
                base = int(segment.sum(dtype=np.int64))
                counts = [base, *(int(self._plain(before + part[:j]).sum(dtype=np.int64)) for j in range(1, len(part))), base + 1]
                out.append(np.diff(np.array(counts)).astype(np.int8))
        return np.concatenate(out)

    def _plain(self, text: str) -> np.ndarray:
        units, held = self._find(text), self.units
        try:
            joined = b"".join(map(held.__getitem__, units))
        except KeyError:
            joined = b"".join(map(self._of, units))
        return np.frombuffer(joined, np.int8)


@lru_cache(maxsize=4)
def counter(file: str = DEFAULT_FILE) -> PrefixCounter:
    return PrefixCounter(tokenizer_path(file))


def prefix_counts(text: str | None, file: str = DEFAULT_FILE) -> np.ndarray:
    """Tokens of text[:i] for i in 0..len(text)."""
    steps = counter(file).text_steps(text or "")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def token_counts(docs: DataFrame, limit: int = 1024, file: str = DEFAULT_FILE, keep_steps: bool = False) -> DataFrame:
    """One row for each document: bytes, tokens, and the code points of its longest prefix within `limit` tokens.

    With keep_steps also `steps`: the changes of the count at each code point, one signed
    byte each, from which tokens_within() and tokens_upto() answer later questions.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, limit_chars long" + ", steps binary" * keep_steps

    @lean
    def run(batches):
        of = counter(file).text_steps
        for b in batches:
            ids, rows = b.column(0), []
            for text in b.column(1):
                text = text.as_py() or ""
                steps = of(text)
                n = int(steps.sum(dtype=np.int64))
                chars = len(text)
                if n > limit or (len(steps) and chars > limit):
                    within = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= limit)
                    chars = int(within[-1]) + 1 if len(within) else 0
                rows.append((len(text.encode()), n, chars, steps.tobytes() if keep_steps else None))
            columns = list(zip(*rows)) or [()] * 4
            arrays = [ids, *(pa.array(c, pa.int64()) for c in columns[:3])] + [pa.array(columns[3], pa.binary())] * keep_steps
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "limit_chars"] + ["steps"] * keep_steps)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def tokens_upto(steps: bytes, chars: int) -> int:
    """Tokens of the prefix of that many code points."""
    return int(np.frombuffer(steps, np.int8)[:chars].sum(dtype=np.int64))


def tokens_within(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    within = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def digest(counted: DataFrame, limit: int = 1024) -> DataFrame:
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "limit_chars")
