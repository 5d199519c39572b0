"""Named queries over files that they write first: pools, runs, sheets, manifests, and a run from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import arms as X
from ..operators import fourarm as A
from ..operators import gates as V
from ..operators import gold as G
from ..operators import traps as Q
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.scratch import folder
from .evidence import _EDIT
from .fixture import FOURARM, TURNS, fourarm, table, tokens_sql, turns
from .reports import _KNOWN, _items, _memory

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ITEMS = "WITH p AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS ord FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)"
_NQ = "'nq-' || ord"


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")


def _json_array(rows: DataFrame, path: str) -> None:
    """Rows in the order of their first column as one JSON array, which is what a pool's file is; pools are question sets, not corpora."""
    rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("value")).coalesce(1).write.text(path)


def _pool(spark: SparkSession, sf_dir: str, answers) -> DataFrame:
    ctx = lambda title, text: F.array(F.struct(title.alias("title"), text.alias("text")))
    rows = _benchmark(spark, sf_dir).select(
        "item_id", F.concat(F.lit("Q"), F.col("item_id").cast("string")).alias("question"), answers.alias("answers"), ctx(F.lit("t"), F.col("text")).alias("positive_ctxs"),
        F.when(F.col("item_id") % 2 == 0, ctx(F.lit("h"), F.lit("no"))).otherwise(F.array().cast(R.CTX)).alias("hard_negative_ctxs"),
    )
    path = folder(spark, "pool")
    _json_array(rows, path)
    return R.pool(spark, path, "nq")


def _typed():
    return F.array(F.when(F.col("item_id") % 3 == 0, "1984").when(F.col("item_id") % 3 == 1, "12.5").otherwise("word"), F.lit(" "))


@query(f"""{_ITEMS}, q AS (SELECT *, {_NQ} AS question_id, CASE item_id % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'numeric' ELSE 'name' END AS answer_type FROM p)
SELECT question_id, answer_type, 0 AS ord, question_id || ':positive_ctxs:0' AS doc_id, 'positive_ctxs' AS grp, length(text) AS n_chars FROM q
UNION ALL SELECT question_id, answer_type, 1, question_id || ':hard_negative_ctxs:0', 'hard_negative_ctxs', 2 FROM q WHERE item_id % 2 = 0""")
def pool_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of a retriever-format pool, written and read."""
    questions = _pool(spark, sf_dir, _typed())
    rows = R.paragraphs(questions).join(questions.select(F.col("id").alias("question_id"), "answer_type"), "question_id")
    return rows.select("question_id", "answer_type", "ord", "doc_id", "grp", F.char_length("text").cast("long").alias("n_chars"))


@query(f"{_ITEMS} SELECT ord, 'corpus:' || ord AS doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS n_tokens FROM p WHERE item_id % 3 < 2")
def corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared corpus of the questions of two answer types."""
    kept = G.type_slice(_pool(spark, sf_dir, _typed()), ("date", "numeric"))
    return R.corpus(kept).select(F.col("ord").cast("long").alias("ord"), "doc_id", F.size("tokens").cast("long").alias("n_tokens"))


_WORD = "regexp_extract(lower(text), '([a-z]{4,})', 1)"


@query(f"{_ITEMS} SELECT {_NQ} AS question_id, ({_WORD} <> '')::INT AS n_gold, {_WORD} AS gold_keys FROM p")
def single_hop_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold passages by an alias that the positive passage holds."""
    questions = _pool(spark, sf_dir, F.array(F.regexp_extract(F.lower("text"), "([a-z]{4,})", 1)))
    return G.single_hop(questions).select("question_id", F.size("gold").alias("n_gold"), F.array_join("gold_keys", ",").alias("gold_keys"))


@query("SELECT 'm' || item_id AS question_id, CASE WHEN item_id % 2 = 0 THEN 'bridge' ELSE 'comparison' END AS answer_type, 2 AS n_gold, text || '|x' || item_id AS gold FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL")
def multihop_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold sentences of a multi-hop pool, written and read."""
    own = F.col("item_id").cast("string")
    rows = _benchmark(spark, sf_dir).select(
        "item_id", F.concat(F.lit("m"), own).alias("_id"), F.lit("Q").alias("question"), F.lit("yes").alias("answer"), F.when(F.col("item_id") % 2 == 0, "bridge").otherwise("comparison").alias("type"),
        F.struct(F.array(F.lit("A"), F.lit("B")).alias("title"), F.array(F.array(F.concat(F.lit("s"), own), F.col("text")), F.array(F.concat(F.lit("x"), own))).alias("sentences")).alias("context"),
        F.struct(F.array(F.lit("B"), F.lit("A")).alias("title"), F.array(F.lit(0), F.lit(1)).alias("sent_id")).alias("supporting_facts"),
    )
    path = folder(spark, "multihop")
    _json_array(rows, path)
    questions = R.pool(spark, path, "hotpot")
    return G.multi_hop(questions).join(questions.select(F.col("id").alias("question_id"), "answer_type"), "question_id").select("question_id", "answer_type", F.size("gold").alias("n_gold"), F.array_join("gold_sentences", "|").alias("gold"))


@query(f"WITH {FOURARM} SELECT k, count(*) AS n, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b, sum(c)::BIGINT AS c, sum(d)::BIGINT AS d, count(*) FILTER (passed_gates) AS n_pp FROM fourarm WHERE model = 'm1' AND k IN (1, 5) GROUP BY k")
def arms_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two depths as JSON lines by label, read with every check."""
    rows, path = fourarm(spark, sf_dir, (1, 5)).where("model = 'm1'"), folder(spark, "runs")
    for k in (1, 5):
        out = rows.where(F.col("k") == k).select(F.col("question_id").cast("string").alias("question_id"), "model", F.lit(f"k={k}").alias("config_key"), *A.ARMS, "passed_gates")
        K.run_outputs({"arms": out}, path, f"k{k}")
    held = R.checked_arms(spark, {k: f"{path}/run_label=k{k}/arms" for k in (1, 5)})
    return held.groupBy("k").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in A.ARMS], F.count_if("passed_gates").alias("n_pp"))


@query("SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS ok, 'a ' || doc_id || ' b' AS note FROM documents")
def sheet_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with flags in several spellings, written and read."""
    word = F.when(F.col("doc_id") % 4 == 0, "yes").when(F.col("doc_id") % 4 == 1, "否").when(F.col("doc_id") % 4 == 2, "").otherwise("T")
    path = folder(spark, "sheet")
    K.tsv(table(spark, sf_dir, "documents").select("doc_id", word.alias("Is it correct"), F.concat(F.lit("a\t"), F.col("doc_id").cast("string"), F.lit("\nb")).alias("Notes")), path)
    return R.sheet(spark, path, {"doc_id": ("doc_id",), "ok": ("correct",), "note": ("note",)}, ("ok",))


@query("SELECT 'run' AS label, 'm1,m2' AS models, 1 AS n_files, length(c) + 1 AS length, sha256(c || chr(10)) AS sha256 FROM (SELECT string_agg(item_id, ',' ORDER BY item_id) AS c FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's hash, and the manifest of a run that read it."""
    path = folder(spark, "manifest")
    _benchmark(spark, sf_dir).agg(F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("value")).coalesce(1).write.text(path)
    made = K.manifest(spark, "run", "mini", [path], ["m1", "m2"], "k=1", {"n": 1}, {})
    return made.crossJoin(F.broadcast(K.file_hashes(spark, [path]))).select("label", F.array_join("models", ",").alias("models"), F.size("data_sha256").alias("n_files"), "length", "sha256")


_ASKED = "'Q: ' || text || chr(10) || CASE WHEN role = 'user' THEN 'A:' ELSE 'A: The answer is' END"


@query(rf"""WITH {TURNS}, t AS (SELECT conv_id, turn, role, text, answer, {tokens_sql('text')} AS q, {tokens_sql('answer')} AS p FROM turns)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND answer <> '' THEN md5('Read the following context and answer the question with the shortest possible answer. Strictly follow the context; if the context says a value, use that exact value.' || chr(10) || 'Context: ' || answer || chr(10) || chr(10) || {_ASKED})
  ELSE md5('Answer the question with the shortest possible answer.' || chr(10) || {_ASKED}) END AS prompt_md5,
  CASE WHEN len(q) = 0 THEN 0 ELSE round(len(list_filter(q, lambda w: list_contains(p, w))) / len(q), 9) END AS recall,
  ('0x' || right(sha256(text), 4))::BIGINT AS seed FROM t""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of base and chat models with and without a context, the passage's unigram recall and a seed from the text."""
    from ..functions import numeric as N

    t = turns(spark, sf_dir)
    context, model = F.when(F.col("turn") % 2 == 0, F.col("answer")), F.when(F.col("role") == "user", "m-Instruct").otherwise("m")
    return t.select("conv_id", "turn", F.md5(T.prompt(F.col("text"), context, T.is_instruct(model))).alias("prompt_md5"), F.round(T.unigram_recall(T.answer_tokens("text"), T.answer_tokens("answer")), 9).alias("recall"), N.hash_mod(F.col("text"), F.lit(65536).cast("long")).alias("seed"))


@query("""SELECT lang AS grp, count(*) AS n, sum((doc_id % 7 = 0)::INT)::BIGINT AS noop, round(avg((doc_id % 7 = 0)::INT), 9) AS rate, median(1 + doc_id % 3)::DOUBLE AS median_forms, round(avg(1 + doc_id % 3), 2) AS mean_forms
FROM documents GROUP BY lang""")
def trap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that put another spelling of the old answer in its place."""
    own = F.col("doc_id").cast("string")
    forms = F.concat(F.array(F.concat(F.lit("The Value "), own), F.lit("the")), F.transform(F.slice(F.array(F.lit("x y"), F.lit("z")), 1, (F.col("doc_id") % 3).cast("int")), lambda x: x))
    new = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("value "), own, F.lit("!"))).otherwise("another")
    return Q.noop_audit(table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), new.alias("new_key"), forms.alias("aliases")), "grp")


@query("""WITH c AS (SELECT doc_id, unnest([{'t': 'c0_gold', 's': 1}, {'t': 'c1_k5', 's': 5}, {'t': 'c2_w1', 's': 2}, {'t': 'c2_w2', 's': 2}, {'t': 'c2_w3', 's': 2}, {'t': 'c2_w4', 's': 2}, {'t': 'c3_k1_actual', 's': 1}]) AS x FROM documents)
SELECT x.t AS tag, count(*) AS n, sum(((doc_id + x.s) % 3 = 0)::INT)::BIGINT AS answered_new, round(avg(((doc_id + x.s) % 3 = 0)::INT), 9) AS rate FROM c WHERE x.t <> 'c3_k1_actual' OR doc_id % 3 <> 0 GROUP BY x.t""")
def window_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that tell a single bad window from dilution."""
    d = F.col("doc_id")
    items = table(spark, sf_dir, "documents").select(d.alias("question_id"), (d + d % 3).alias("gold_id"), F.array(d).alias("shallow"), F.sequence(d, d + 4).alias("deep"))
    return Q.window_attribution(Q.window_conditions(items), (F.col("question_id") + F.size("ids")) % 3 == 0)


@query(f"""WITH {_EDIT}, r AS (SELECT question_id, ({_KNOWN})::INT AS a FROM ap WHERE n_old = 1),
s AS (SELECT *, unnest(['require_pair_hit', 'structural_only']) AS policy FROM r)
SELECT policy, count(*) AS n, round(avg(1 - a), 9) AS apparent_gain, 1.0::DOUBLE AS corrected_gain, count(*) FILTER (policy = 'structural_only' OR question_id % 2 = 0) AS n_pp,
  round(avg(-a) FILTER (policy = 'structural_only' OR question_id % 2 = 0), 9) AS did_pp FROM s GROUP BY policy""")
def end_to_end_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits, four arms of a stub generator, run files by label, checked loading, and the summary under each protocol policy."""
    path = folder(spark, "end-to-end")
    run(_items(spark, sf_dir), X.stub(_memory()), path, "run")
    held = R.checked_arms(spark, {1: f"{path}/run_label=run/arms"})
    out = None
    for policy in ("require_pair_hit", "structural_only"):
        rows = held.withColumn("passed_gates", A.eligible(policy, F.col("question_id").cast("long") % 2 == 0)).withColumn("policy", F.lit(policy))
        out = rows if out is None else out.unionByName(rows)
    return A.summary(out, "policy").select("policy", "n", "apparent_gain", "corrected_gain", "n_pp", "did_pp")


def run(items: DataFrame, generator, path: str, label: str, model: str = "stub", config_key: str = "k=1") -> None:
    """Writes a run: the arms of each item, the broken constraints among them, and the summary."""
    arms = X.four_arms(items, generator).select(F.col("question_id").cast("string").alias("question_id"), F.lit(model).alias("model"), F.lit(config_key).alias("config_key"), *A.ARMS, F.lit(True).alias("passed_gates"))
    K.run_outputs({"arms": arms}, path, label)
    held = R.fourarm(items.sparkSession, f"{path}/run_label={label}/arms")
    K.run_outputs({"issues": A.issues(held, config_key), "summary": A.summary(A.valid(held), "model")}, path, label)


@query("""WITH r AS (SELECT doc_id, coalesce(lang, 'xx') AS l, coalesce(source, 's') AS s, trim(substr(coalesce(text, ''), 1, 20)) <> '' AS has_text FROM documents)
SELECT count(*) AS "all", count(*) FILTER (l <> s) AS has_aliases, count(*) FILTER (l <> s AND has_text) AS has_pages, count(*) FILTER (l <> s AND has_text AND doc_id % 5 <> 0) AS no_cooccurrence FROM r""")
def pool_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a reading-comprehension pool that pass each step of its conversion."""
    lang, source, text = F.coalesce("lang", F.lit("xx")), F.coalesce("source", F.lit("s")), F.substring(F.coalesce("text", F.lit("")), 1, 20)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.struct(lang.alias("normalized_value"), F.array(lang, F.lit(" "), source).alias("aliases")).alias("answer"),
        F.struct(F.array(F.lit("t"), F.lit("e")).alias("title"), F.array(text, F.lit("")).alias("search_context")).alias("search_results"), F.struct(F.array(F.lit("E")).alias("title"), F.array(source).alias("wiki_context")).alias("entity_pages"),
    )
    seen = rows.select("doc_id", F.size(G.clean_aliases(F.col("answer"))).alias("n_aliases"), F.size(G.candidate_pages(F.col("search_results"), F.col("entity_pages"))).alias("n_pages"))
    return G.funnel(seen, {"has_aliases": F.col("n_aliases") > 1, "has_pages": F.col("n_pages") > 1, "no_cooccurrence": V.gate7((F.col("doc_id") % 5 == 0).cast("int"))})
