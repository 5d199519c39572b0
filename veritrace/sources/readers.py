"""Readers of question pools and run artifacts: explicit schemas, hard checks, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

CTX = "ARRAY<STRUCT<title: STRING, text: STRING>>"
RETRIEVER_POOL = f"question STRING, answers ARRAY<STRING>, positive_ctxs {CTX}, hard_negative_ctxs {CTX}, negative_ctxs {CTX}"
MULTIHOP_POOL = "_id STRING, question STRING, answer STRING, type STRING, context STRUCT<title: ARRAY<STRING>, sentences: ARRAY<ARRAY<STRING>>>, supporting_facts STRUCT<title: ARRAY<STRING>, sent_id: ARRAY<INT>>"
FOURARM = "question_id STRING, model STRING, config_key STRING, a INT, b INT, c INT, d INT, passed_gates BOOLEAN"
ORACLE = (
    "question_id STRING, dataset STRING, question STRING, gold STRING, answer_type STRING, term_key STRING, term_present BOOLEAN, new_aliases ARRAY<STRING>, old_aliases ARRAY<STRING>, "
    "ora_orig STRING, ora_sub STRING, em_orig INT, em_sub INT, cls_sub STRING, arms_raw STRUCT<cb_orig: STRING, cb_sub: STRING, open_orig: STRING, open_sub: STRING>, arms_em STRUCT<a: INT, b: INT, c: INT, d: INT>"
)
GATE = "STRUCT<gate_id: INT, passed: BOOLEAN, value: DOUBLE, detail: STRING, status: STRING, verdict: STRING>"
SUBSTITUTED = (
    "question_id STRING, old_key STRING, new_key STRING, old_passage STRING, new_passage STRING, terminal_key STRING, "
    f"proposal STRUCT<char_span: ARRAY<INT>, old: STRING, new: STRING, type: STRING, reason: STRING, passage_doc_id: STRING, role: STRING>, gates MAP<STRING, {GATE}>"
)
MEMSTRENGTH = (
    "question_id STRING, model STRING, dataset STRING, answer_type STRING, old STRING, new STRING, cont_style STRING, bits INT, "
    "lp STRUCT<old: STRUCT<sum_lp: DOUBLE, mean_lp: DOUBLE, first_lp: DOUBLE, n_tok: INT, boundary: STRING>, new: STRUCT<sum_lp: DOUBLE, mean_lp: DOUBLE, first_lp: DOUBLE, n_tok: INT, boundary: STRING>>, margin_mean DOUBLE"
)
EVSWAP = "question_id STRING, model STRING, question STRING, gold STRING, gold_ctx_tokens INT, repl_ctx_tokens INT, repl_doc_ids ARRAY<STRING>, n_repl_clean INT, n_gold_paras INT, raw_nogold STRING, em_nogold INT, em_gold INT, em_sub INT, cls_sub STRING"
ANNOTATION = "task_id STRING, question_id STRING, doc_id STRING, old STRING, new STRING, subject STRING, old_passage STRING, new_passage STRING, semantic_unique BOOLEAN, relation_plausible BOOLEAN, labeler STRING, comment STRING"
RC_ROWS = (
    "question STRING, answer STRUCT<normalized_value: STRING, aliases: ARRAY<STRING>>, search_results STRUCT<rank: ARRAY<INT>, title: ARRAY<STRING>, url: ARRAY<STRING>, search_context: ARRAY<STRING>>, "
    "entity_pages STRUCT<title: ARRAY<STRING>, wiki_context: ARRAY<STRING>>"
)


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with ord, their place in the file; a pool's file is one JSON array, so it is one partition."""
    return df.withColumn("ord", F.row_number().over(W.orderBy(F.monotonically_increasing_id())) - 1)


def retriever_pool(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Questions with nested paragraphs from a retriever-format JSON array; blank answers go."""
    rows = _numbered(spark.read.schema(RETRIEVER_POOL).json(path, multiLine=True))
    group = lambda name: F.transform(F.coalesce(F.col(name), F.array().cast(CTX)), lambda x, j: F.struct(F.concat(F.lit(f"{dataset}-"), F.col("ord").cast("string"), F.lit(f":{name}:"), j.cast("string")).alias("doc_id"), x["title"].alias("title"), x["text"].alias("text"), F.lit(name).alias("grp")))
    answers = F.filter(F.coalesce("answers", F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    return rows.select(
        F.concat(F.lit(f"{dataset}-"), F.col("ord").cast("string")).alias("id"), F.lit(dataset).alias("dataset"), F.col("question").alias("text"), answers.alias("answers"),
        T.answer_type(F.coalesce(F.get(answers, F.lit(0)), F.lit(""))).alias("answer_type"), F.concat(group("positive_ctxs"), group("hard_negative_ctxs"), group("negative_ctxs")).alias("paragraphs"), "ord",
    )


def multihop_pool(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a multi-hop JSON array; a paragraph's text is its sentences joined by a space, which are kept too."""
    rows = _numbered(spark.read.schema(MULTIHOP_POOL).json(path, multiLine=True))
    para = F.transform(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences")), lambda x, j: F.struct(F.concat(F.coalesce("_id", F.concat(F.lit("hotpot-"), F.col("ord").cast("string"))), F.lit(":ctx:"), j.cast("string")).alias("doc_id"), x["title"].alias("title"), F.array_join(x["sentences"], " ").alias("text"), x["sentences"].alias("sentences")))
    facts = F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent_idx"))
    return rows.select(F.coalesce("_id", F.concat(F.lit("hotpot-"), F.col("ord").cast("string"))).alias("id"), F.lit("hotpot").alias("dataset"), F.col("question").alias("text"), F.array("answer").alias("answers"), T.answer_type("answer", F.col("type")).alias("answer_type"), facts.alias("support_facts"), para.alias("paragraphs"), "ord")


def pool(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    return multihop_pool(spark, path) if dataset == "hotpot" else retriever_pool(spark, path, dataset)


def paragraphs(questions: DataFrame) -> DataFrame:
    """question_id, ord and the fields of each paragraph."""
    return questions.select(F.col("id").alias("question_id"), F.posexplode("paragraphs").alias("ord", "p")).select("question_id", "ord", "p.*")


def corpus(questions: DataFrame) -> DataFrame:
    """Shared corpus: each question's first positive passage, with its tokens and normalised text; the number is the question's."""
    first = F.get(F.filter("paragraphs", lambda p: p["grp"] == "positive_ctxs"), F.lit(0))
    return questions.withColumn("p", first).where("p IS NOT NULL").select("ord", F.concat(F.lit("corpus:"), F.col("ord").cast("string")).alias("doc_id"), F.col("p.text").alias("text"), T.bm25_tokens(F.col("p.text")).alias("tokens"), T.normalize_answer(F.col("p.text")).alias("norm"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines artifact under a fixed schema: fields of newer versions are null in older files, blank lines are skipped, malformed lines fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def fourarm(spark: SparkSession, path: str) -> DataFrame:
    """Arms of runs (a path or glob), with passed_gates true where it was not recorded."""
    return json_lines(spark, path, FOURARM).withColumn("passed_gates", F.coalesce("passed_gates", F.lit(True))).withColumn("run", F.input_file_name())


def gates(rows: DataFrame) -> DataFrame:
    """Gate results of substituted rows; older files have neither status nor verdict."""
    g = rows.select("question_id", F.explode("gates").alias("key", "g")).select("question_id", "key", "g.*")
    return g.withColumns({"status": F.coalesce("status", F.lit("JUDGED")), "verdict": F.coalesce("verdict", "status", F.lit("JUDGED"))})


def parquet_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Shards that exist; a missing one is warned about and passed over."""
    import warnings

    found = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found.append(p)
        else:
            warnings.warn(f"missing shard {p}", stacklevel=2)
    if not found:
        raise FileNotFoundError("none of the shards exists")
    return spark.read.parquet(*found)


def one_path(spark: SparkSession, folder: str, suffix: str, holds: str = "") -> str:
    """The one file of a folder whose name ends so and holds so; anything else is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [str(s.getPath()) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    hits = [n for n in names if n.endswith(suffix) and holds in n.rsplit("/", 1)[-1]]
    if len(hits) != 1:
        raise ValueError(f"{len(hits)} files in {folder} end with {suffix!r} and hold {holds!r}")
    return hits[0]


def assert_same_keys(x: DataFrame, y: DataFrame, key: str) -> None:
    """Fails unless both have the same keys, each once."""
    sides = x.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(y.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    bad = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where("l <> 1 OR r <> 1").limit(5).collect()
    if bad:
        raise ValueError(f"keys differ or repeat: {[r[key] for r in bad]}")


def checked_arms(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Arms of one model's runs by depth k. Fails unless every run has the same items, each once, arms are 0 or 1, and
    the closed-book arms a and c of an item are the same at every depth."""
    runs = {k: fourarm(spark, path) for k, path in paths.items()}
    first, *others = runs.values()
    assert_same_keys(first, first.select("question_id"), "question_id")
    for other in others:
        assert_same_keys(first, other, "question_id")
    rows = None
    for k, run in runs.items():
        run = run.withColumn("k", F.lit(k))
        rows = run if rows is None else rows.unionByName(run)
    arm = lambda c: F.coalesce(F.col(c).isin(0, 1), F.lit(False))
    found = rows.groupBy("question_id").agg(F.bool_and(arm("a") & arm("b") & arm("c") & arm("d")).alias("valid"), (F.count_distinct("a") + F.count_distinct("c")).alias("closed"))
    bad = found.where("NOT valid OR closed <> 2").limit(5).collect()
    if bad:
        raise ValueError(f"arms are not 0 or 1, or closed-book arms differ between depths: {[r['question_id'] for r in bad]}")
    return rows


def last_per_key(rows: DataFrame, key: str, ord_: str) -> DataFrame:
    """The last row written for each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), ord_).alias("x")).select(key, "x.*")


# What sheets may hold for true and false.
TRUE_WORDS = ("是", "true", "t", "1", "y", "yes", "对", "合格")
FALSE_WORDS = ("否", "false", "f", "0", "n", "no", "错", "不合格")


def sheet(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]], flags: tuple[str, ...]) -> DataFrame:
    """A TSV sheet: columns by parts of their headers; flags are true, false or empty, and any other word fails."""
    raw = spark.read.csv(path, sep="\t", header=True)
    picked = []
    for name, keys in columns.items():
        hit = next((c for c in raw.columns if any(k.lower() in c.lower() for k in keys)), None)
        if hit is None:
            raise ValueError(f"no column for {name}")
        c = F.col(f"`{hit}`")
        if name in flags:
            word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
            c = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).when(word == "", F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), word)).cast("boolean"))
        picked.append(c.alias(name))
    return raw.select(*picked)
