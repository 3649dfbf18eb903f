"""Graders on small answers; the judge asks each question once."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators import graders as G
from caseloom.operators import judge as J

DDL = "ord bigint, case_id string, output string, error string, model_requests array<string>, input string, docs array<struct<title:string,text:string>>, choices array<string>, answer string, qaPairs array<struct<question:string,shortAnswers:array<string>>>, clauses array<struct<text:string,passages:array<int>>>, protected array<string>, graders array<string>"
DOCS = [("A", "The first clause of this contract says that the licence ends in May."), ("B", "Nothing of note stands here."), (None, "A later passage repeats the licence.")]


def answers(spark, *rows):
    base = {"output": "", "error": None, "requests": None, "input": "", "docs": DOCS, "choices": None, "answer": None, "pairs": None, "clauses": None, "protected": None, "graders": []}
    full = [base | r for r in rows]
    return spark.createDataFrame([(i, f"c-{i}", r["output"], r["error"], r["requests"], r["input"], r["docs"], r["choices"], r["answer"], r["pairs"], r["clauses"], r["protected"], r["graders"]) for i, r in enumerate(full)], DDL)


def grades(df):
    return {r.ord: (r["pass"], r.score) for r in df.collect()}


def test_exact_and_str_em(spark):
    a = answers(spark, {"output": "Label: yes", "choices": ["Yes", "No"], "answer": "Yes", "graders": ["exact"]}, {"output": None, "choices": ["Yes"], "answer": "Yes", "graders": ["exact"]}, {"output": "It was the Ann Lee, 1901.", "pairs": [("q", ["ann lee"]), ("r", ["1902", "1903"]), ("s", [])], "graders": ["str-em"]})
    assert grades(G.exact(a)) == {0: (True, 1.0), 1: (False, 0.0)}
    row = G.str_em(a).first()
    assert (row["pass"], row.score) == (False, pytest.approx(1 / 3)) and row.detail == "1/3 sub-questions answered; missing: 1902 | "


def test_clauses(spark):
    clause = [("The first clause of this contract says that the licence ends", [0, 2])]
    quote = "The first clause of this contract says that the licence ends in May"
    rows = [(f'"{quote}" [1]', clause), (f'"{quote}"', clause), ("Yes [1].", clause), (f"{quote} [1][2]", clause), ("There is no such clause.", []), ("See [2].", [])]
    a = answers(spark, *[{"output": o, "clauses": c, "graders": ["clause-recall", "clause-precision"]} for o, c in rows])
    assert grades(G.clause_recall(a)) == {0: (True, 1.0), 1: (False, 0.0), 2: (False, 0.0), 3: (True, 1.0), 4: (True, 1.0), 5: (False, 0.0)}
    assert grades(G.clause_precision(a)) == {0: (True, 1.0), 1: (False, 0.0), 2: (True, 1.0), 3: (False, 0.5), 4: (True, 1.0), 5: (False, 0.0)}


def containment(asked):
    yes = F.contains(F.lower("premise"), F.lower(F.regexp_replace("claim", "[.]$", "")))
    return asked.withColumn("reply", F.when(yes, " Yes.").otherwise("no"))


def test_citations(spark):
    out = "The licence ends in May [1]. Nothing of note stands here [1][2]. No citation here."
    a = answers(spark, {"output": out, "graders": ["citation-recall", "citation-precision"]}, {"output": "", "graders": ["citation-recall", "citation-precision"]})
    assert grades(G.citation_recall(a, containment)) == {0: (False, pytest.approx(2 / 3)), 1: (False, 0.0)}
    # of [1][2] only [2] is needed: without [1] the sentence still holds
    assert grades(G.citation_precision(a, containment)) == {0: (False, pytest.approx(2 / 3)), 1: (False, 0.0)}


def test_each_question_is_asked_once(spark):
    asked = spark.createDataFrame([("p", "entails", "x y", "x"), ("p", "entails", "x y", "x"), ("q", "entails", "", "")], "prompt string, kind string, premise string, claim string").withColumn("row", F.monotonically_increasing_id())
    seen = spark.sparkContext.accumulator(0)

    def model(prompt):
        seen.add(1)
        return "yes" if prompt == "p" else "no"

    out = J.ruled(asked, J.model_judge(model), ["row"])
    assert sorted(r.yes for r in out.collect()) == [False, True, True] and seen.value == 2
    out.collect()
    assert seen.value == 2


def test_redaction(spark):
    a = answers(
        spark,
        {"output": "Call [X] at ANN  LEE's.", "input": "Call Bob at Ann Lee's house now now", "requests": ["Call Bob"], "protected": ["Bob", "Ann Lee"], "graders": ["removal", "leakage", "retention"]},
        {"output": "Call house now now", "input": "Call Bob at Ann Lee's house now now", "protected": ["Bob", "Ann Lee"], "graders": ["removal", "leakage", "retention"]},
    )
    assert grades(G.removal(a)) == {0: (False, 0.5), 1: (True, 1.0)}
    assert grades(G.leakage(a)) == {0: (False, 0.5), 1: (None, None)}
    assert grades(G.retention(a)) == {0: (False, pytest.approx(1 / 4)), 1: (True, 1.0)}


def test_dispatch_and_gold(spark):
    a = answers(spark, {"graders": ["exact", "nobody"], "choices": ["Yes"], "answer": "Yes", "output": "Yes"}, {"graders": ["exact"], "choices": ["Yes"], "answer": "Yes", "error": "boom"}, {"graders": ["exact"], "answer": "Yes"}, {"graders": []})
    got = {(r.ord, r.grader): (r["pass"], r.status) for r in G.dispatch(a).collect()}
    assert got == {(0, "exact"): (True, "ok"), (0, "nobody"): (False, "grade_error"), (1, "exact"): (False, "run_error"), (2, "exact"): (False, "grade_error")}
    wrong = G.gold_problems(a.select(F.col("case_id").alias("id"), "graders", "answer", "qaPairs", "clauses", "protected"))
    assert {(r.id, r.problem) for r in wrong.collect()} == {("c-0", "unknown grader"), ("c-3", "no graders")}
