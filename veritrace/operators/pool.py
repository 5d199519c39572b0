"""Value pool and borrowing: candidates by bucket, ladders of relaxed preferences, a hashed pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import numeric as N
from ..functions import text as T
from . import automaton as M

# Question kinds by their wording, tried in this order.
QUESTION_KINDS = (
    ("count", r"(?i)\bhow (many|much)\b"),
    ("year", r"(?i)\b(which|what|in what|of what) year\b|\bwhat year\b"),
    ("time", r"(?i)^\s*(when|in what year|on what date|what date)\b"),
    ("person", r"(?i)\b(who|whose|whom)\b"),
    ("place", r"(?i)\bwhich (city|town|village|country|state|county|island|region|place|capital)\b"),
    ("work", r"(?i)\bwhich (album|song|single|film|movie|book|novel|play|musical|opera|series|band|group|company|team|club|magazine|newspaper|painting|sculpture)\b"),
    ("org", r"(?i)\bwhich (company|organisation|organization|agency|party|army|navy|airline|university|college|school|hospital|museum|church|cathedral)\b"),
)
NUMBER_KINDS = ("count", "year", "time")


def question_kind(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in QUESTION_KINDS:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("other")


def kinds_agree(candidate: Column, target: Column) -> Column:
    """Both ask for a number, or neither; an unknown candidate agrees."""
    return candidate.isNull() | (candidate.isin(*NUMBER_KINDS) == target.isin(*NUMBER_KINDS))


def same_value(new: Column, old: Column) -> Column:
    """Equal after normalisation, or one holds the other and both have three characters or more."""
    a, b = T.normalize_answer(new), T.normalize_answer(old)
    inside = (F.length(a) >= 3) & (F.length(b) >= 3) & (F.contains(a, b) | F.contains(b, a))
    return (a != "") & (b != "") & ((a == b) | inside)


def bucket(kind: Column, value: Column, strict_era: bool = SETTINGS.strict_era) -> Column:
    """date:year, date:full, date:era:<n>, numeric:<digits> or name."""
    multi = kind.isin("bridge", "comparison")
    four = F.trim(value).rlike(r"^[0-9]{4}$")
    date = F.when(four, "date:year").otherwise("date:full")
    if strict_era:
        date = F.when(N.era(value).isNotNull(), F.concat(F.lit("date:era:"), N.era(value).cast("string"))).otherwise(date)
    return (
        F.when((kind == "date") | (multi & four), date)
        .when((kind == "numeric") | (multi & F.trim(value).rlike(r"^[0-9.,]+$")), F.concat(F.lit("numeric:"), N.magnitude_bin(value).cast("string")))
        .otherwise("name")
    )


def build_pool(answers: DataFrame, strict_era: bool = SETTINGS.strict_era) -> DataFrame:
    """bucket, value and pool order. answers: ord, kind, value; yes and no of comparisons stay out; years in an era bucket also count as years."""
    usable = answers.where((F.trim("value") != "") & ~((F.col("kind") == "comparison") & F.lower(F.trim("value")).isin("yes", "no")))
    rows = usable.withColumn("bucket", bucket(F.col("kind"), F.col("value"), strict_era))
    both = F.array_compact(F.array(F.col("bucket"), F.when(F.col("bucket").startswith("date:era:"), F.lit("date:year"))))
    return rows.select(F.explode(both).alias("bucket"), "value", "ord").groupBy("bucket", "value").agg(F.min("ord").alias("ord"))


def ladder(kind: Column, value: Column, strict_era: bool = SETTINGS.strict_era) -> Column:
    """Buckets to try, best first: array of (prio, bucket)."""
    own = bucket(kind, value, strict_era)
    first = F.array(F.struct(F.lit(0).alias("prio"), own.alias("bucket")))
    if not strict_era:
        return first
    near = [F.struct(F.lit(p).alias("prio"), F.concat(F.lit("date:era:"), (N.era(value) + d).cast("string")).alias("bucket")) for p, d in enumerate((1, -1, 2, -2, 3, -3), 1)]
    last = F.struct(F.lit(7).alias("prio"), F.lit("date:year").alias("bucket"))
    return F.when(own.startswith("date:era:"), F.concat(first, F.array(*near, last))).otherwise(first)


def signatures(questions: DataFrame) -> DataFrame:
    """Topic words of each question: the commonest words in two questions or more but at most a small share of them; ties by word. questions: question_id, text."""
    word = questions.select("question_id", F.explode(F.array_distinct(T.long_words("text", SETTINGS.signature_min_len))).alias("word"))
    df = word.groupBy("word").agg(F.count("*").alias("df"))
    cut = questions.agg(F.greatest(F.lit(4), F.floor(F.lit(SETTINGS.signature_df_share) * F.count("*"))).alias("cut"))
    usable = word.join(df, "word").join(F.broadcast(cut)).where((F.col("df") >= 2) & (F.col("df") <= F.col("cut")))
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("df"), "word"))
    best = usable.withColumn("rank", rank).where(F.col("rank") <= SETTINGS.signature_words)
    return best.groupBy("question_id").agg(F.array_sort(F.collect_list("word")).alias("signature"))


def borrow(targets: DataFrame, pool: DataFrame, strict_era: bool = SETTINGS.strict_era) -> DataFrame:
    """A value for each target: of the first bucket on its ladder that has a usable one, the hash(question|old) mod n-th in pool order.

    Usable: other than the old value and absent from the passage. targets: question_id, kind,
    old, passage. Targets without a value are left out. No list of candidates is collected: a
    window numbers them.
    """
    step = targets.select("question_id", "kind", "old", "passage", F.explode(ladder(F.col("kind"), F.col("old"), strict_era)).alias("l")).select("*", "l.*").drop("l")
    usable = step.join(pool, "bucket").where((F.col("value") != F.col("old")) & (T.whole_count("passage", "value") == 0))
    w = W.partitionBy("question_id")
    first = usable.withColumn("best", F.min("prio").over(w)).where("prio = best")
    numbered = first.withColumns({"n": F.count("*").over(w), "i": F.row_number().over(w.orderBy("ord", "value")) - 1})
    pick = numbered.where(F.col("i") == N.hash_mod(F.concat_ws("|", F.col("question_id").cast("string"), "old"), F.col("n")))
    return pick.select("question_id", "old", F.col("value").alias("new"), "bucket", F.col("n").alias("n_candidates"))


def fictional(kind: Column, old: Column) -> Column:
    """An invented value: a number of as many digits, or a near year; never a name."""
    digits = F.length(F.regexp_replace(old, "[^0-9]", ""))
    low = F.pow(F.lit(10.0), digits - 1).cast("long")
    number = (low + N.hash_mod(F.concat(F.lit("fiction|"), old), (low * 9).cast("long"))).cast("string")
    near = (N.year(old) + F.element_at(F.array(*[F.lit(d) for d in (7, -7, 11, -11, 13, -13)]), (N.hash_mod(F.concat(F.lit("year|"), old), F.lit(6)) + 1).cast("int"))).cast("string")
    return F.when(kind == "date", near).when(kind == "numeric", number).otherwise(F.raise_error(F.lit("names are never invented")).cast("string"))


def prefer(rows: DataFrame, flag: Column, key: str) -> DataFrame:
    """The rows of each key that the flag marks; all of a key's rows where it marks none."""
    w = W.partitionBy(key)
    marked = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    return marked.withColumn("_any", F.bool_or("_flag").over(w)).where(F.col("_flag") | ~F.col("_any")).drop("_flag", "_any")


def borrow_names(targets: DataFrame, pool: DataFrame, typed: bool = SETTINGS.strict_entity_type) -> DataFrame:
    """A name for each target by a ladder of preferences, none of which may empty its candidates.

    Not one of the question's own spellings; not the same value in other words; with `typed`
    of an agreeing kind; then the first level that has any: two topic words in common and as
    many words, one topic word and as many words, as many words, anything.
    targets: question_id, old, forms, signature, band, asks, passage. pool: value, ord, signature, band, asks."""
    p = pool.select("value", "ord", F.col("signature").alias("p_signature"), F.col("band").alias("p_band"), F.col("asks").alias("p_asks"))
    rows = targets.join(p, (F.col("value") != F.col("old")) & (T.whole_count("passage", "value") == 0))
    rows = prefer(rows, ~F.array_contains("forms", T.normalize_answer("value")), "question_id")
    rows = prefer(rows, ~same_value(F.col("value"), F.col("old")), "question_id")
    if typed:
        rows = prefer(rows, kinds_agree(F.col("p_asks"), F.col("asks")), "question_id")
    shared, band = F.size(F.array_intersect("signature", "p_signature")), F.col("band") == F.col("p_band")
    level = F.when(band & (shared >= SETTINGS.signature_overlap), 0).when(band & (shared >= 1), 1).when(band, 2).otherwise(3)
    w = W.partitionBy("question_id")
    best = rows.withColumn("level", level).withColumn("least", F.min("level").over(w)).where("level = least")
    numbered = best.withColumns({"n": F.count("*").over(w), "i": F.row_number().over(w.orderBy("ord", "value")) - 1})
    return numbered.where(F.col("i") == N.hash_mod(F.concat_ws("|", F.col("question_id").cast("string"), "old"), F.col("n"))).select("question_id", "old", F.col("value").alias("new"), "level", F.col("n").alias("n_candidates"))


def cooccurrences(pairs: DataFrame, paragraphs: DataFrame, block_bytes: int = M.BLOCK_BYTES) -> DataFrame:
    """Paragraphs that hold both strings of each pair, in lower case, anywhere; 0 where none does. pairs: subject, value.

    One automaton finds the subjects of each paragraph; the pairs of those subjects, joined by equality, are then sought in
    what another finds of their values. An empty string is in every paragraph."""
    both = pairs.select("subject", "value", F.lower("subject").alias("s"), F.lower("value").alias("v")).distinct()
    low = paragraphs.select(F.monotonically_increasing_id().alias("id"), F.lower("text").alias("text")).where(F.col("text").isNotNull())
    names = both.select(F.explode(F.array("s", "v")).alias("name"))
    found = M.occurring(low, "text", names, "name", block_bytes).select("id", F.explode("found").alias("name"))
    found = found.groupBy("id").agg(F.collect_set("name").alias("found"))  # of one text, which holds them all
    held = found.select("found", F.explode("found").alias("s"))
    some = both.where("s <> '' AND v <> ''")
    n = some.join(held, "s").where(F.array_contains("found", F.col("v"))).groupBy("subject", "value").agg(F.count("*").alias("n"))
    # pairs with an empty side: counts of the other one, or of all paragraphs
    one = held.groupBy(F.col("s").alias("name")).agg(F.count("*").alias("n"))
    half = both.where("(s = '') <> (v = '')").withColumn("name", F.concat("s", "v")).join(one, "name").select("subject", "value", "n")
    none = both.where("s = '' AND v = ''").join(F.broadcast(low.agg(F.count("*").alias("n")))).select("subject", "value", "n")  # one row
    counts = n.unionByName(half).unionByName(none)
    out = both.select("subject", "value").join(counts, ["subject", "value"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def alias_closure(answers: DataFrame) -> DataFrame:
    """All spellings of the questions that share a normalised spelling with each question: one hop. answers: question_id, aliases."""
    form = answers.select("question_id", F.explode(F.array_distinct(F.transform("aliases", T.normalize_answer))).alias("form")).where("form <> ''")
    near = form.join(form.select("form", F.col("question_id").alias("other")), "form").select("question_id", "other").distinct()
    return near.join(form.select(F.col("question_id").alias("other"), "form"), "other").groupBy("question_id").agg(F.array_sort(F.collect_set("form")).alias("forms"))
