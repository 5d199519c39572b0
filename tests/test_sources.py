"""Readers, sinks, gold evidence, windows, arms and annotation."""

import json

import pytest
from pyspark.sql import functions as F

from veritrace.operators import annotate as AN
from veritrace.operators import arms as X
from veritrace.operators import gold as G
from veritrace.sources import readers, sinks

NQ = [
    {"question": "who", "answers": ["Paris", " "], "positive_ctxs": [{"title": "t", "text": "In Paris."}], "hard_negative_ctxs": [{"title": "h", "text": "x"}], "negative_ctxs": []},
    {"question": "when", "answers": ["1815"], "positive_ctxs": [], "negative_ctxs": [{"title": "n", "text": "in 1815"}]},
]
HOP = [{"_id": "h1", "question": "q", "answer": "yes", "type": "comparison", "context": {"title": ["A", "B"], "sentences": [["a1.", "a2."], ["b1."]]}, "supporting_facts": {"title": ["A", "A"], "sent_id": [1, 7]}}]


@pytest.fixture
def files(tmp_path):
    (tmp_path / "nq.json").write_text(json.dumps(NQ))
    (tmp_path / "hop.json").write_text(json.dumps(HOP))
    (tmp_path / "empty.json").write_text("[]")
    return tmp_path


def test_pools(spark, files):
    q = readers.pool(spark, str(files / "nq.json"), "nq")
    rows = q.orderBy("ord").collect()
    assert [r.id for r in rows] == ["nq-0", "nq-1"] and rows[0].answers == ["Paris"] and [r.answer_type for r in rows] == ["name", "date"]
    assert [p.doc_id for p in rows[0].paragraphs] == ["nq-0:positive_ctxs:0", "nq-0:hard_negative_ctxs:0"]
    assert [r.doc_id for r in readers.corpus(q).collect()] == ["corpus:0"] and readers.paragraphs(q).count() == 3
    gold = {r.question_id: [p.grp for p in r.gold] for r in G.single_hop(q).collect()}
    assert gold == {"nq-0": ["positive_ctxs"], "nq-1": ["negative_ctxs"]}
    assert readers.pool(spark, str(files / "empty.json"), "nq").count() == 0


def test_multihop(spark, files):
    q = readers.pool(spark, str(files / "hop.json"), "hotpot")
    r = q.first()
    assert r.answer_type == "comparison" and r.paragraphs[0].text == "a1. a2."
    g = G.multi_hop(q).first()
    assert g.gold_sentences == ["a2."] and [p.title for p in g.gold] == ["A"]


def test_artifacts(spark, files):
    (files / "x_fourarm.jsonl").write_text('{"question_id":"1","model":"m","config_key":"c","a":1,"b":1,"c":0,"d":1}\n\n{"question_id":"2","model":"m","config_key":"c","a":0,"b":1,"c":0,"d":1,"passed_gates":false}\n')
    path = readers.one_path(spark, str(files), "_fourarm.jsonl")
    rows = readers.fourarm(spark, path)
    assert sorted((r.question_id, r.passed_gates) for r in rows.collect()) == [("1", True), ("2", False)]
    with pytest.raises(ValueError):
        readers.one_path(spark, str(files), ".json")
    readers.assert_same_keys(rows, rows, "question_id")
    with pytest.raises(ValueError):
        readers.assert_same_keys(rows, rows.where("a = 1"), "question_id")
    last = readers.last_per_key(spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "k int, v string, o int"), "k", "o").first()
    assert last.v == "y"


def test_missing_shards_warn(spark, files):
    spark.range(3).write.parquet(str(files / "a.parquet"))
    with pytest.warns(UserWarning):
        assert readers.parquet_shards(spark, [str(files / "a.parquet"), str(files / "b.parquet")]).count() == 3


def test_sheets(spark, files):
    (files / "s.tsv").write_text("Task id\tunique?\n1\tYes\n2\t否\n3\t\n")
    read = lambda: readers.sheet(spark, str(files / "s.tsv"), {"task_id": ("task",), "ok": ("unique",)}, ("ok",))
    assert [r.ok for r in read().orderBy("task_id").collect()] == [True, False, None]
    (files / "s.tsv").write_text("Task id\tunique?\n1\tmaybe\n")
    with pytest.raises(Exception, match="not a flag"):
        read().collect()


def test_sinks(spark, files):
    rows = spark.createDataFrame([(1, "a\tb", None)], "i int, s string, x boolean")
    sinks.tsv(rows, str(files / "t"))
    assert spark.read.csv(str(files / "t"), sep="\t", header=True).first().s == "a b"
    sinks.run_outputs({"rows": rows}, str(files / "out"), "r1")
    assert spark.read.json(str(files / "out")).first().run_label == "r1"
    h = sinks.file_hashes(spark, [str(files / "nq.json")])
    import hashlib

    assert h.first().sha256 == hashlib.sha256((files / "nq.json").read_bytes()).hexdigest() and sinks.tree_hash(h).first().n_files == 1
    m = sinks.manifest(spark, "l", "pilot", [str(files / "nq.json")], ["m"], "k", {"n": 2}, {}).first()
    assert json.loads(m.settings)["seed"] == 20260903 and len(m.data_sha256) == 1
    assert sinks.render([{"a": "x", "b": 0.5}, {"a": "yy", "b": None}], ["a", "b"], "T").splitlines() == ["T", "a       b", "x   0.500", "yy      -"]


def test_annotation_tasks(spark):
    gate = "map<string, struct<passed: boolean>>"
    rows = spark.createDataFrame([("q", "o", "n", (("a", "b", "d"),)[0], {"6": (True,)}), ("r", "o", "n", ("a", "b", "d"), {"6": (None,)})], f"question_id string, old_passage string, new_passage string, proposal struct<old: string, new: string, passage_doc_id: string>, gates {gate}")
    assert [r.task_id for r in sinks.annotation_tasks(rows).collect()] == ["q:d"]


def test_windows(spark):
    text = "filler " * 60 + "the battle of Waterloo was fought in 1815 near Brussels " + "filler " * 60
    pages = spark.createDataFrame(
        [(1, 0, "Which battle was fought near Brussels?", ["1815"], "nothing 1815 here"), (1, 1, "Which battle was fought near Brussels?", ["1815"], text), (1, 2, "Which battle was fought near Brussels?", ["1815"], "clean page"), (2, 0, "Who?", ["X"], "no alias")],
        "question_id int, page int, question string, aliases array<string>, text string",
    )
    w = G.windows(pages).collect()
    assert [(r.question_id, r.page, r.alias) for r in w] == [(1, 1, "1815")] and "1815" in w[0].window and len(w[0].window) <= 2 * 260 + 4
    assert [(r.question_id, r.page) for r in G.negatives(pages).orderBy("question_id").collect()] == [(1, 2), (2, 0)]


def test_neighbouring_aliases_bound_a_window(spark):
    pages = spark.createDataFrame([(1, 0, "battle fought", ["1815"], "1815 x. battle fought 1815 and 1815")], "question_id int, page int, question string, aliases array<string>, text string")
    r = G.windows(pages).first()
    assert r.window.count("1815") == 1


def test_arms(spark):
    items = spark.createDataFrame([(1, "q", "1815", "1820", ["1815"], "in 1815", "in 1820"), (2, "q", "x", "y", ["x"], "none", "none")], "question_id int, question string, old string, new string, old_aliases array<string>, orig_context string, sub_context string")
    got = {r.question_id: (r.a, r.b, r.c, r.d) for r in X.four_arms(items, X.stub(F.col("question_id") == 1)).collect()}
    assert got == {1: (1, 1, 0, 1), 2: (0, 0, 0, 0)}

    def shout(batches):
        for b in batches:
            yield b["context"].fillna("").str.extract(r"(\d+)")[0].fillna("no")

    got = {r.question_id: (r.a, r.b, r.c, r.d) for r in X.four_arms(items, X.from_batches(shout)).collect()}
    assert got[1] == (0, 1, 0, 1)


def test_parsing_of_model_outputs(spark):
    raw = 'say {"a": "}"} then {"start": 3, "end": 7, "old": "1815", "new": "1820"}'
    row = spark.createDataFrame([(raw, "in 1815", '{"start": 3, "end": 7, "old": "1815", "new": "1820"} x', "a\nVERDICT: No\n")], "r string, p string, j string, v string")
    r = row.select(X.first_json_object("r").alias("o"), X.parsed_proposal(F.col("j"), F.col("p")).alias("x"), X.span_verdict(F.col("v")).alias("v"), X.span_verdict(F.col("p")).alias("n")).first()
    assert r.o == '{"a": "}"}' and r.x.new == "1820" and r.v == "no" and r.n is None


def test_annotation(spark):
    a = spark.createDataFrame([(k, k % 2 == 0) for k in range(10)] + [(50, None)], "task_id int, ok boolean")
    b = spark.createDataFrame([(k, k % 2 == 0 or k == 1) for k in range(10)] + [(50, None)], "task_id int, ok boolean")
    both = AN.merged(a, b, ("ok",))
    assert both.where("adjudicated").count() == 10
    r = AN.agreement(both, ("ok",)).first()
    assert r.n == 10 and r.conflicts == 1 and 0.7 < r.kappa < 1
    ids = spark.range(1000)
    assert [r.id for r in AN.systematic(ids, 90, "id").orderBy("id").collect()] == [k * 1000 // 90 for k in range(90)]
    parts = AN.split(ids, {"pilot": 10, "eval": 20}, "id").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"pilot": 10, "eval": 20, "rest": 970}
    words = spark.createDataFrame([(w,) for w in ["b", None, "a", "c", "a"]], "w string")
    assert [(r.w, r.place) for r in AN.global_rank(words, "w").orderBy("place").collect()] == [(None, 0), ("a", 1), ("a", 2), ("b", 3), ("c", 4)]
    assert AN.global_rank(words.limit(0), "w").count() == 0
    one = AN.subset(ids, 10, "id")
    assert AN.subset(ids, 10, "id", exclude=one).join(one, "id").count() == 0


def test_answer_windows_look_for_every_item_in_every_document(spark, tmp_path):
    from veritrace.plans import reports

    text = "so the old zebra crossing lay near brussels market square"
    spark.createDataFrame([(3, "nothing here"), (7, text), (8, None), (90, "a zebras' crossings only")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, f"near brussels {w} crossing market square") for k, w in ((57, "zebra"), (199, "zebra"), (2, "horse"))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.question_id, r.page, r.alias) for r in reports.answer_windows(spark, str(tmp_path)).collect()}
    assert {(q, p) for q, p, _ in got} == {(57, 7), (199, 7), (2, 7)}


def test_pages_of_leaves_no_hit_out(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["An X-ray of foo, bar foo bar", "xray", "the q. été of foo bar", "Foo Bar's foo bar", "foobar", ""])], "page int, text string")
    ask = spark.createDataFrame([(1, "foo bar", ["X-ray", ""]), (2, "foo bar", ["é", "foo"]), (3, "foo bar", ["bar's"]), (4, "foo bar", ["of foo"])], "question_id int, question string, aliases array<string>")
    rows = lambda pages: sorted(map(tuple, G.windows(pages, least=0).collect()))
    assert rows(G.pages_of(ask, docs)) == rows(ask.crossJoin(docs)) != []


def test_best_windows_search_each_page_once(spark):
    words = "foo bar baz of X-ray foo, q.q. İstanbul été, market".split()
    docs = spark.createDataFrame([(k, " ".join(words[(k * j + k) % len(words)] for j in range(2 + k * 3))) for k in range(24)] + [(90, None), (91, ""), (92, "the q. été of foo bar"), (93, "foobar xray")], "page int, text string")
    asked = [(1, "foo bar market", ["X-ray", ""]), (2, "foo bar", ["é", "foo", " Foo "]), (3, "foo bar", ["bar's"]), (4, "foo bar baz", ["foo x", "bar", "x-ray foo"]), (5, "foo market", ["été", "q.", ","]), (6, "no", []), (7, "bar market baz", ["foo"])]
    ask = spark.createDataFrame(asked, "question_id int, question string, aliases array<string>")
    rows = lambda pages: sorted(map(tuple, pages.collect()))
    for least, radius in ((0, 260), (2, 9)):
        assert rows(G.best_windows(ask, docs, least=least, radius=radius)) == rows(G.windows(G.pages_of(ask, docs), least=least, radius=radius)) != []


def test_breakdown_is_of_strict_failures(spark):
    rows = spark.createDataFrame([("42",), ("Sure. It is 42.",), ("41.",), ("",), ("not mentioned",), ("x",)], "raw string")
    r = X.compliance(rows.select("raw", F.array(F.lit("42")).alias("new_aliases"), F.array(F.lit("41")).alias("old_aliases"))).first()
    assert (r.n, r.strict_new, r.lenient_new) == (6, round(1 / 6, 9), round(2 / 6, 9)) and (r.n_empty, r.n_new, r.n_old, r.n_refusal, r.n_other) == (1, 1, 1, 1, 1)


def test_a_model_is_loaded_once_for_a_partition(spark):
    def counted(batches):
        loads = {"n": 0}
        loads["n"] += 1
        for k, b in enumerate(batches):
            yield b["question"].map(lambda q: f"{q}|{loads['n']}|{k}")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.range(0, 10, 1, 1).select("id", F.concat(F.lit("q"), "id").alias("question"), F.lit("").alias("context"))
        got = [r.raw_output for r in X.from_batches(counted)(rows).orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [f"q{k}|1|{k // 3}" for k in range(10)]


def test_flags_are_the_words_of_the_sheets(spark):
    from veritrace.sources.readers import FALSE_WORDS, TRUE_WORDS

    assert "合格" in TRUE_WORDS and "不合格" in FALSE_WORDS and not {"√", "×"} & {*TRUE_WORDS, *FALSE_WORDS}
