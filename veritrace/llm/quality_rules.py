"""Quality rules as a short-circuit cascade of column expressions.

Each rule is a predicate "this text fails". On a bounded sample each is timed as the
cascade will evaluate it (over words that are split already, or over measures that are at
hand), at two sizes so that the cost of a job falls out, and its verdicts are kept. The
order is greedy: next comes the rule with the most rejections per cost among the texts that
the rules before it leave. The cascade stops at the first rule that fails. The order changes
the work, never the verdict.

Everything is a built-in expression: no Python runs on the executors.

Odd inputs. Null text has no words; a text without words fails `few_words`. Very long texts
are measured whole, but do not enter the sample. Repeated rows get a row each, an empty table
gives an empty one, and of rules that tie the cheaper and then the first by name goes first.
Extra columns are neither read nor in the way: `measured` selects by name, `keep_good` adds none.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bounds of the estimate: rows, and bytes of a text that may enter the sample.
SAMPLE_ROWS, SAMPLE_BYTES = 256, 32_768


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


def word_chars(text: Column) -> Column:
    return F.char_length(F.translate(F.coalesce(text, F.lit("")), WHITE_CHARS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, WHITE_CHARS, "") != "")


def repeated_in(w: Column) -> Column:
    """Words of the array w that lie in a window of five words found twice or more.

    Hashes of the windows decide first whether any could repeat; only then are the
    windows themselves sorted, so that the count is exact and the usual text is cheap.
    """
    starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))

    def counted(s: Column) -> Column:
        # s: (window, position) in order; a window repeats if a neighbour has the same words
        hit = F.transform(
            F.filter(
                F.transform(s, lambda x, i: F.struct(x["p"].alias("p"), ((F.get(s, i - 1)["v"] == x["v"]) | (F.get(s, i + 1)["v"] == x["v"])).alias("r"))),
                lambda x: F.coalesce(x["r"], F.lit(False)),
            ),
            lambda x: x["p"],
        )
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        fold = F.aggregate(
            F.array_sort(hit),
            start,
            lambda a, p: F.struct((a["n"] + (p + WINDOW - F.greatest(a["end"], p))).cast("long").alias("n"), (p + WINDOW).alias("end")),
        )
        return fold["n"]

    each = F.transform(w, lambda x: F.xxhash64(x))
    hashed = let(each, lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(-1, WINDOW - 1)])))
    exact = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("v"), i.alias("p"))))
    none = F.lit(0).cast("long")
    return F.when(F.size(w) <= WINDOW, none).otherwise(
        let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(let(exact, counted)))
    )


def _share_over(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


def _upper(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return let(F.char_length(F.regexp_replace(t, r"[^\p{Lu}]+", "")), lambda up: let(F.char_length(F.regexp_replace(t, r"[^\p{L}]+", "")), lambda all_: _share_over(up, all_, 50)))


@dataclass(frozen=True)
class Measures:
    """What rules read: columns of a table where they are at hand, or expressions over the text and its words."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_repeat_words: Column
    #: lines with a word, and those equal to an earlier one
    lines: Callable[[Callable[[Column, Column], Column]], Column]

    @staticmethod
    def of(text: Column, w: Column) -> Measures:
        lines = lambda body: let(_lines(text), lambda x: body(F.size(x), F.size(x) - F.size(F.array_distinct(x))))
        return Measures(text, F.size(w).cast("long"), word_chars(text), n_symbols(text), repeated_in(w), lines)

    @staticmethod
    def at_hand() -> Measures:
        """Columns of measures()."""
        c = F.col
        return Measures(c("text"), c("w.n_words"), c("w.word_chars"), c("n_symbols"), c("w.n_repeat_words"), lambda body: body(c("l.n_lines"), c("l.n_dup_lines")))


@dataclass(frozen=True)
class Rule:
    name: str
    #: true where the text fails
    fails: Callable[[Measures], Column]


FEW_WORDS = Rule("few_words", lambda m: m.n_words < 10)
REPEATS = Rule("repeats", lambda m: _share_over(m.n_repeat_words, m.n_words, 20))
BASE = (FEW_WORDS, REPEATS)
RULES = (
    *BASE,
    Rule("symbols", lambda m: _share_over(m.n_symbols, m.n_words, 20)),
    Rule("dup_lines", lambda m: m.lines(lambda n, dup: _share_over(dup, n, 50))),
    Rule("word_length", lambda m: let(F.struct(m.n_words.alias("n"), m.word_chars.alias("c")), lambda x: (x["c"] > 20 * x["n"]) | (x["c"] < 2 * x["n"]))),
    Rule("shouting", lambda m: _upper(m.text)),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    #: for a text
    seconds: float
    #: of each text of the sample, whether the rule rejects it
    rejects: tuple[bool, ...]

    @property
    def rejected(self) -> float:
        return sum(self.rejects) / max(len(self.rejects), 1)


def estimate(sample: DataFrame, fails: Callable[[Rule], Column], base: Column, rules: tuple[Rule, ...] = RULES, times: tuple[int, int] = (1, 9)) -> list[Estimate]:
    """Cost and rejections of each rule on a bounded table; fails gives a rule's column over it, of whose cost that of base
    is no part: the cascade pays it once whatever the order."""
    rows = sample.collect()
    if not rows:
        return [Estimate(r, 1e-9, ()) for r in rules]
    held = sample.sparkSession.createDataFrame(rows, sample.schema)
    columns = [F.coalesce(fails(r), F.lit(True)) for r in rules]
    verdicts = held.select(*(f.alias(str(k)) for k, f in enumerate(columns))).collect()

    def seconds(f: Column, n: int) -> float:
        more = held.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("__k"))
        began = time.perf_counter()
        more.agg(F.count(F.when(f, 1))).collect()
        return time.perf_counter() - began

    def for_a_text(f: Column) -> float:
        seconds(f, times[0])  # its code is made here, not in what is timed
        few, many = (seconds(f, n) for n in times)
        return (many - few) / (len(rows) * (times[1] - times[0]))

    paid = for_a_text(base)
    return [Estimate(rule, max(for_a_text(f) - paid, 1e-9), tuple(v[k] for v in verdicts)) for k, (rule, f) in enumerate(zip(rules, columns))]


def ordered(estimates: list[Estimate]) -> list[Rule]:
    """By rejections per cost, counted among the texts that earlier rules leave."""
    left, out = list(estimates), []
    alive = list(range(len(estimates[0].rejects) if estimates else 0))
    while left:
        best = min(left, key=lambda e: (-sum(e.rejects[k] for k in alive) / e.seconds, e.seconds, e.rule.name))
        left.remove(best)
        out.append(best.rule)
        alive = [k for k in alive if not best.rejects[k]]
    return out


def cascade(measures: Measures, order: list[Rule] | tuple[Rule, ...]) -> Column:
    """Name of the first rule in this order that rejects the text, else null; later rules are not evaluated."""
    out = None
    for rule in order:
        fails = F.coalesce(rule.fails(measures), F.lit(True))
        out = F.when(fails, rule.name) if out is None else out.when(fails, rule.name)
    return F.lit(None).cast("string") if out is None else out


def rejected_by(text: Column, order: list[Rule] | tuple[Rule, ...]) -> Column:
    """The cascade over a text, whose words are split once for all rules."""
    return let(words(text), lambda w: cascade(Measures.of(text, w), order))


def _sample(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(text).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).limit(SAMPLE_ROWS)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with docs' columns."""
    own = F.col("text")
    order = ordered(estimate(_sample(docs, text), lambda r: rejected_by(own, [r]).isNotNull(), let(words(own), lambda w: F.size(w) < 0), rules))
    return docs.where(rejected_by(docs[text], order).isNull())


def measures(docs: DataFrame, *columns: str) -> DataFrame:
    """columns, text, and the base measures of each text; words and lines are split once."""
    return docs.select(
        *columns,
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_in(w).alias("n_repeat_words"))).alias("w"),
        n_symbols(F.col("text")).alias("n_symbols"),
        let(_lines(F.col("text")), lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        "text",
    )


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: the base measures and the cascade's verdict.

    The base measures are asked for in every row, so the base rules read them; the
    remaining rules run as a cascade, and only where the base passes.
    """
    rest, at_hand = tuple(r for r in rules if r not in BASE), Measures.at_hand()
    order = ordered(estimate(measures(_sample(docs, "text")), lambda r: r.fails(at_hand), F.col("n_symbols") < 0, rest))
    failed = (at_hand.n_words < 10) | _share_over(at_hand.n_repeat_words, at_hand.n_words, 20)
    return measures(docs, "doc_id").select(
        "doc_id",
        at_hand.n_words.alias("n_words"),
        at_hand.word_chars.alias("word_chars"),
        "n_symbols",
        F.col("l.n_dup_lines").alias("n_dup_lines"),
        at_hand.n_repeat_words.alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.when(failed, False).otherwise(cascade(at_hand, order).isNull()).alias("kept"),
    )


#: The measures in DuckDB's SQL; each window becomes a row there.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS v FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, v) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM rep) GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(n_lines, 0) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS up, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters
      FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
       OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 100 * up > 50 * letters) AS kept
FROM m"""
