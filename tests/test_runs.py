"""Reconciled artifacts: whole ones pass, each broken one fails when it is read; grids restart and equal single runs."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from veritrace.operators import arms as X
from veritrace.operators import grid as G
from veritrace.sources import runs as U

NAMES = ("oracle", "arms", "substituted", "memory")
LP = {"sum_lp": -2.0, "mean_lp": -1.0, "first_lp": -1.5, "n_tok": 2, "boundary": "space"}


def lines():
    ids = ["q1", "q2", "q3"]
    return {
        "oracle": [{"question_id": i, "arms_em": {"a": 0, "b": 1, "c": 0, "d": 1}} for i in ids],
        "arms": [{"question_id": i, "model": "m", "config_key": "k=1", "a": 0, "b": 1, "c": 0, "d": 1} for i in ids],
        "substituted": [{"question_id": i, "old_key": "x", "new_key": "y"} for i in ids],
        "memory": [{"question_id": i, "model": "m", "dataset": "d", "lp": {"old": LP if i != "q3" else None, "new": LP}, "margin_mean": 0.0} for i in ids],
    }


def written(spark, path, held):
    for name, rows in held.items():
        (path / "run_label=r" / name).mkdir(parents=True)
        (path / "run_label=r" / name / "part.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return U.read(spark, str(path), "r", *NAMES)


def test_whole_artifacts_are_joined(spark, tmp_path):
    sides = written(spark, tmp_path, lines())
    rows, seen = U.fingerprinted(U.reconciled(sides))
    assert rows.count() == 3 and seen.get["n"] == 3
    other, seen2 = U.fingerprinted(sides["arms"].orderBy(F.desc("question_id")), "other")
    other.collect()
    assert seen2.get["keys"] == seen.get["keys"]
    assert U.gaps(sides).count() == 0
    pairs = {r["question_id"]: r for r in U.memory_pairs(U.reconciled(sides)).collect()}
    assert set(pairs) == {"q1", "q2"} and pairs["q1"]["apparent"] == 1 and pairs["q1"]["masking"] == 0 and pairs["q1"]["lp_old_sum"] == -2.0


def _drop(held, name):
    held[name].pop()


def _repeat(held, name):
    held[name].append(held[name][0])


BROKEN = {
    **{f"{n} lacks it": lambda h, n=n: _drop(h, n) for n in NAMES},
    **{f"{n} repeats it": lambda h, n=n: _repeat(h, n) for n in NAMES},
    "arms differ from those recorded": lambda h: h["oracle"][1]["arms_em"].update(b=0),
    "arms are not 0 or 1": lambda h: (h["arms"][0].update(a=2), h["oracle"][0]["arms_em"].update(a=2)),
    "the edit has no new key": lambda h: h["substituted"][2].update(new_key="  "),
    "no question_id": lambda h: [h[n].append(h[n][0] | {"question_id": None}) for n in NAMES],
}


@pytest.mark.parametrize("fault", BROKEN)
def test_broken_artifacts_fail(spark, tmp_path, fault):
    held = lines()
    BROKEN[fault](held)
    sides = written(spark, tmp_path, held)
    assert fault in {r["fault"] for r in U.gaps(sides).collect()}
    rows = U.reconciled(sides)  # a plan is no job: nothing fails yet
    with pytest.raises(Exception, match=fault):
        rows.agg(F.count("*")).collect()  # even where no column is asked for


CELL = "question_id string, a int, b int, c int, d int, passed_gates boolean"


def test_space_of_cells(spark):
    cell = lambda *rows: spark.createDataFrame([(*r, True) for r in rows], CELL)
    one = cell(("x", 1, 0, 0, 1), ("y", 0, 0, 0, 0))
    assert U.space({"k1": one, "k2": cell(("y", 0, 1, 0, 1), ("x", 1, 1, 0, 1))}).count() == 4
    for bad, said in ((cell(("x", 1, 0, 0, 1)), "items"), (cell(("x", 1, 0, 0, 1), ("x", 1, 0, 0, 1), ("y", 0, 0, 0, 0)), "items"), (cell(("x", 0, 0, 0, 1), ("y", 0, 0, 0, 0)), "closed-book"), (cell(("x", None, 0, 0, 1), ("y", 0, 0, 0, 0)), "closed-book")):
        with pytest.raises(Exception, match=said):
            U.space({"k1": one, "k2": bad}).count()


@pytest.fixture
def tables(spark):
    asked = spark.createDataFrame([("p", "who?", "old", "new", ["old"], True), ("q", "what?", "was", "is", ["was"], True), ("r", "no hits", "o", "n", ["o"], False)], "question_id string, question string, old string, new string, old_aliases array<string>, passed_gates boolean")
    hits = [("p", "orig", 1, "aa bb", 2, False), ("p", "orig", 2, "old one", 2, True), ("p", "orig", 3, "cc", 1, False), ("p", "sub", 1, "new one", 2, True), ("p", "sub", 2, "dd dd dd", 3, False), ("p", "sub", 3, "ee", 1, False), ("q", "orig", 1, "was " * 5, 5, True), ("q", "sub", 1, "nothing", 1, False)]
    return asked, spark.createDataFrame(hits, "question_id string, side string, rank int, text string, n_words int, is_gold boolean")


def test_contexts_are_prefixes(spark, tables):
    ranked = G.prefixed(tables[1])
    got = {(r["question_id"], r["side"]): (r["context"], r["n_docs"], r["has_gold"]) for r in G.contexts(ranked, G.Cell("m", 3, 4)).collect()}
    # four words: a text that does not fit ends the context, also for shorter ones after it
    assert got == {("p", "orig"): ("aa bb\nold one", 2, True), ("p", "sub"): ("new one", 1, True), ("q", "sub"): ("nothing", 1, False)}


def test_grid_restarts_and_equals_single_runs(spark, tables, tmp_path):
    asked, ranked = tables
    ranked = G.prefixed(ranked).cache()
    data = tmp_path / "data.txt"
    data.write_text("x")
    grid, made = list(G.cells(["m/1", "m2"], [1, 2], [4])), []

    def generator_of(model):
        made.append(model)
        return X.stub(F.lit(model == "m2"))

    path = f"file://{tmp_path}/cells"
    assert G.run(asked, ranked, generator_of, grid, path, [f"file://{data}"]) == ["m_1-k1-b4", "m_1-k2-b4", "m2-k1-b4", "m2-k2-b4"]
    assert made == ["m/1", "m2"]
    for cell in grid:
        alone = {r["question_id"]: tuple(r[x] for x in "abcd") for r in X.four_arms(G.items_of(asked, ranked, cell), X.stub(F.lit(cell.model == "m2"))).collect()}
        held = {r["question_id"]: tuple(r[x] for x in "abcd") for r in G.held(spark, path, "audit", G.AUDIT).where(F.col("run_label") == cell.label).collect()}
        assert held == alone and len(held) == 3
    rows = {(r["model"], r["config_key"], r["question_id"]): r for r in G.held(spark, path, "audit", G.AUDIT).collect()}
    assert (rows["m/1", "k=2;budget=4", "p"]["orig_has_gold"], rows["m/1", "k=1;budget=4", "p"]["orig_has_gold"]) == (True, False)
    assert rows["m2", "k=1;budget=4", "r"]["orig_n_docs"] == 0 and rows["m2", "k=1;budget=4", "r"]["a"] == 1
    # finished cells are passed over; one without its manifest is not finished
    assert G.run(asked, ranked, generator_of, grid, path, [f"file://{data}"]) == []
    shutil.rmtree(tmp_path / "cells" / "run_label=m2-k1-b4" / "manifest")
    assert G.held(spark, path, "audit", G.AUDIT).select("run_label").distinct().count() == 3
    assert G.run(asked, ranked, generator_of, grid, path, [f"file://{data}"]) == ["m2-k1-b4"]
    assert G.held(spark, path, "audit", G.AUDIT).count() == 12
