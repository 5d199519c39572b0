"""Text kernel: answer normalisation, scoring, matching and tokenising as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openings of an answer, tried in this order.
ANSWER_OPENINGS = (
    "the answer is",
    "answer is",
    "answer",
    "the answer",
    "my answer is",
    "i think the answer is",
    "the correct answer is",
    "the short answer is",
)
# Phrases that mark a refusal.
REFUSALS = (
    "none of the provided", "does not mention", "doesn't mention", "does not state",
    "doesn't state", "is not mentioned", "isn't mentioned", "does not contain",
    "doesn't contain", "no information", "no mention", "not mentioned", "not enough",
    "cannot be determined", "cannot determine", "can't be determined", "can't determine",
    "not stated", "not provided", "does not provide", "doesn't provide", "not specified",
    "not available in the", "no context provided", "i don't know", "i don't have",
    "unknown", "not known",
)
# Abbreviations whose full stops end no sentence.
ABBREVIATIONS = ("U.S.", "U.K.", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "St.", "vs.", "etc.", "e.g.", "i.e.", "a.m.", "p.m.")

WORD_EDGE = ("(?<![0-9A-Za-z])", "(?![0-9A-Za-z])")
LOWER_EDGE = ("(?<![0-9a-z])", "(?![0-9a-z])")
#: Beside a number that goes on: digits, or a point or comma between digits.
NUMBER_EDGE = (r"(?<![0-9])(?<![0-9][.,])", r"(?![0-9])(?![.,][0-9])")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def literal(value: Column) -> Column:
    """A regular expression for exactly this value."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def normalize_answer(c: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; null counts as empty."""
    s = F.regexp_replace(F.lower(F.trim(_text(c))), r"\p{Punct}", "")
    s = F.regexp_replace(s, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def extract_answer(c: Column | str, first_sentence: bool = True) -> Column:
    """The answer in a model's output: its first line, without an opening, to the end of the first sentence (or the whole line)."""
    line = strip(F.split_part(strip(_text(c)), F.lit("\n"), F.lit(1)))
    opening = "|".join(ANSWER_OPENINGS)
    rest = strip(F.regexp_replace(line, rf"(?i)^(?:{opening})\s*:?\s*", ""))
    return strip(F.element_at(F.split(rest, r"[.!?;]\s", 2), 1)) if first_sentence else rest


def em(prediction: Column | str, gold: Column | str) -> Column:
    return (normalize_answer(extract_answer(prediction)) == normalize_answer(gold)).cast("int")


def em_any(prediction: Column | str, aliases: Column | str) -> Column:
    """1 if the extracted answer equals any alias after normalisation."""
    p = normalize_answer(extract_answer(prediction))
    al = F.transform(F.coalesce(F.col(aliases) if isinstance(aliases, str) else aliases, F.array().cast("array<string>")), normalize_answer)
    return F.array_contains(al, p).cast("int")


def answer_tokens(c: Column | str) -> Column:
    return F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")


def token_f1(prediction: Column | str, gold: Column | str) -> Column:
    """Token F1 over multisets; two empty sides count 1, one empty side 0."""
    p, g = answer_tokens(prediction), answer_tokens(gold)

    def folded(p: Column, g: Column) -> Column:
        count = lambda xs, w: F.size(F.filter(xs, lambda y: y == w))
        same = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(count(p, w), count(g, w)))
        both = F.size(p) + F.size(g)
        return F.when((F.size(p) == 0) | (F.size(g) == 0), (both == 0).cast("double")).otherwise(F.try_divide(same * F.lit(2.0), both.cast("double")))

    pair = F.transform(F.array(F.struct(p.alias("p"), g.alias("g"))), lambda x: folded(x["p"], x["g"]))
    return F.element_at(pair, 1)


def f1_any(prediction: Column, aliases: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(aliases, lambda a: token_f1(prediction, a))), F.lit(0.0))


def is_number(c: Column) -> Column:
    return c.rlike(r"^[0-9][0-9,]*(?:\.[0-9]+)?$")


def whole_count(text: Column | str, value: Column | str, numeric_strict: bool = False) -> Column:
    """Occurrences of value in text that no letter or digit touches (case counts); strictly, none inside a longer number either."""
    v = F.col(value) if isinstance(value, str) else value
    plain = F.concat(F.lit(WORD_EDGE[0]), literal(v), F.lit(WORD_EDGE[1]))
    pattern = F.when(is_number(v), F.concat(F.lit(WORD_EDGE[0] + NUMBER_EDGE[0]), literal(v), F.lit(NUMBER_EDGE[1] + WORD_EDGE[1]))).otherwise(plain) if numeric_strict else plain
    return F.when(_text(v) == "", F.lit(0)).otherwise(F.regexp_count(_text(text), pattern)).cast("int")


def contains_whole(text: Column, value: Column, edge: tuple[str, str] = LOWER_EDGE) -> Column:
    return F.regexp_like(text, F.concat(F.lit(edge[0]), literal(value), F.lit(edge[1])))


def contain_any(raw: Column, aliases: Column) -> Column:
    """1 if the lower-cased output holds any normalised, non-empty alias as whole words."""
    low = F.lower(_text(raw))
    return F.exists(F.filter(F.transform(aliases, normalize_answer), lambda a: a != ""), lambda a: contains_whole(low, a)).cast("int")


def first_integer(raw: Column) -> Column:
    """First run of digits without its thousands commas, else ''."""
    return F.replace(F.regexp_extract(_text(raw), r"([0-9][0-9,]*)", 1), F.lit(","), F.lit(""))


def value_any(raw: Column, aliases: Column) -> Column:
    """1 if the first integer equals the digits of any alias."""
    v = first_integer(raw)
    digits = F.transform(aliases, lambda a: F.regexp_replace(normalize_answer(a), r"[^0-9]", ""))
    return ((v != "") & F.array_contains(digits, v)).cast("int")


def answer_type(c: Column | str, hop: Column | None = None) -> Column:
    """date, numeric or name by the answer's form; a multi-hop kind wins."""
    a = strip(_text(c))
    form = (
        F.when(a.rlike(r"^(1[0-9]{3}|20[0-9]{2})$") | a.rlike(r"[0-9]{1,4}[-/][0-9]{1,2}"), "date")
        .when(a.rlike(r"^[0-9.,]+$"), "numeric")
        .otherwise("name")
    )
    return form if hop is None else F.when(hop.isin("bridge", "comparison"), hop).otherwise(form)


def classify_output(raw: Column, new: Column, old: Column) -> Column:
    """new before old before other, by exact match."""
    return F.when(em_any(raw, new) == 1, "new").when(em_any(raw, old) == 1, "old").otherwise("other")


def is_refusal(raw: Column) -> Column:
    low = F.lower(extract_answer(raw))
    return F.exists(F.array(*map(F.lit, REFUSALS)), lambda m: F.contains(low, m))


def categorize(raw: Column, new: Column, old: Column) -> Column:
    """empty, new, old, refusal or other: aliases are looked for in the whole output, refusals in the extracted answer."""
    said = F.lower(_text(raw))
    holds = lambda xs: F.exists(F.filter(F.transform(xs, F.lower), lambda a: a != ""), lambda a: contains_whole(said, a))
    return F.when(said == "", "empty").when(holds(new), "new").when(holds(old), "old").when(is_refusal(raw), "refusal").otherwise("other")


def bm25_tokens(c: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(_text(c)), "[^a-z0-9]+"), "")


def long_words(c: Column | str, least: int = 4) -> Column:
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(f"([a-z]{{{least},}})"), F.lit(1))


def content_tokens(c: Column | str, stop: tuple[str, ...]) -> Column:
    words = F.array_distinct(F.filter(bm25_tokens(c), lambda w: F.length(w) > 1))
    return F.array_except(words, F.array(*map(F.lit, stop)))


def token_band(c: Column) -> Column:
    """1, 2 or 3 for one, two or more words."""
    return F.greatest(F.lit(1), F.least(F.lit(3), F.size(F.filter(F.split(strip(_text(c)), r"(?U)\s+"), lambda w: w != ""))))


_HIDE = "\uE000"
_END = r"(?<=[.!?。！？])[\"')\]]?(?U:\s)+"


def sentences(c: Column | str) -> Column:
    """Sentences by their end marks and the white space after them; abbreviations' full stops end none."""
    s = strip(_text(c))
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    # the last stop of an abbreviation is hidden; inner ones have no space after them
    hidden = F.regexp_replace(s, rf"(?i)((?:{names})(?<=\.))(?=(?U:[\"')\]]?\s))", "$1" + _HIDE)
    parts = F.transform(F.split(hidden, _END), lambda p: strip(F.replace(p, F.lit(_HIDE), F.lit(""))))
    return F.filter(parts, lambda p: p != "")


def simple_token_count(c: Column | str) -> Column:
    """Words and single marks."""
    return F.regexp_count(_text(c), F.lit(r"(?U)\w+|[^\w\s]"))


def ngrams(tokens: Column, n: int) -> Column:
    """n consecutive tokens, joined by spaces; none where there are fewer."""
    if n == 1:
        return tokens
    # the tokens are bound to a variable first: inside the inner function the expression would run once for each element
    each = F.transform(F.array(tokens), lambda t: F.when(F.size(t) < n, F.slice(t, 1, 0)).otherwise(F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))))
    return F.element_at(each, 1)


def unigram_recall(question: Column, passage: Column) -> Column:
    """Share of the question's answer_tokens (as often as they occur) that the passage has."""
    hit = F.size(F.filter(question, lambda w: F.array_contains(passage, w)))
    return F.coalesce(F.try_divide(hit.cast("double"), F.size(question).cast("double")), F.lit(0.0))


def bigram_recall(question: Column, passage: Column) -> Column:
    """Share of the question's distinct pairs of neighbouring answer_tokens that the passage has."""
    q, p = F.array_distinct(ngrams(question, 2)), ngrams(passage, 2)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, p)).cast("double"), F.size(q).cast("double")), F.lit(0.0))


# What a prompt says with and without a context, and how it ends for base and for chat models.
WITH_CONTEXT = (
    "Read the following context and answer the question with the shortest possible answer. "
    "Strictly follow the context; if the context says a value, use that exact value.\n"
)
WITHOUT_CONTEXT = "Answer the question with the shortest possible answer.\n"
PROMPT_END = "A: The answer is"
CHAT_END = "A:"


def prompt(question: Column, context: Column, chat: Column | bool = False) -> Column:
    """Prompt with a context, or without where it is null or empty; chat models get no opening of an answer."""
    end = F.when(F.lit(chat) if isinstance(chat, bool) else chat, CHAT_END).otherwise(PROMPT_END)
    ask = F.concat(F.lit("Q: "), question, F.lit("\n"), end)
    return F.when(F.coalesce(context, F.lit("")) == "", F.concat(F.lit(WITHOUT_CONTEXT), ask)).otherwise(F.concat(F.lit(WITH_CONTEXT + "Context: "), context, F.lit("\n\n"), ask))


def is_instruct(model: Column) -> Column:
    """Whether a model is one that takes chat prompts, by its name."""
    return F.endswith(model, F.lit("-Instruct"))
