"""Runs end to end: jobs, calls that are counted and limited, grades with one memo, stored forms, regrading."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators import graders as G
from caseloom.operators import judge as J
from caseloom.operators import runner as R
from caseloom.operators import systems as S
from caseloom.operators.gateway import Gateway, job_id

CASE = "id string, suite string, task string, instructions string, input string, docs array<struct<title:string,text:string>>, examples array<struct<q:string,a:string>>, question string, choices array<string>"
GOLD = "id string, graders array<string>, answer string, qaPairs array<struct<question:string,shortAnswers:array<string>>>, clauses array<struct<text:string,passages:array<int>>>, protected array<string>"
SYSTEMS = "name string, suites array<string>, models map<string,string>, maxCalls bigint"
DOCS = [("A", "The licence of the mill ends in the month of May in each of the years. More text."), ("B", "Nothing of note stands here for the reader of this long passage today.")]


@pytest.fixture(scope="module")
def tables(spark):
    cases = spark.createDataFrame([("l-1", "legalbench", "t", "Decide.", "A case.", None, None, "Is it?", ["Yes", "No"]), ("q-1", "asqa", "asqa", "Answer.", "Question: When?\n\n" + "\n".join(f"Document [{i}](Title: {t}): {x}" for i, (t, x) in enumerate(DOCS, 1)), DOCS, None, None, None)], CASE)
    gold = spark.createDataFrame([("l-1", ["exact", "nobody"], "Yes", None, None, None), ("q-1", ["citation-precision", "citation-recall"], None, None, None, None)], GOLD)
    systems = spark.createDataFrame([("direct", None, {"main": "m1"}, 5), ("direct-4b-v2", ["legalbench"], {"main": "m2"}, None), ("cite-v1", ["asqa"], {"main": "m1"}, 2), ("strange", ["asqa"], {"main": "m1"}, None)], SYSTEMS)
    return systems, cases, gold


def test_a_run(spark, tables):
    systems, cases, gold = tables
    asked = spark.sparkContext.accumulator(0)

    def ask(model, prompt):
        asked.add(1)
        if model == "m2":
            raise TimeoutError("slow")
        return S.scripted(prompt)

    records = R.run_records(systems, cases, reps=2, ask=ask, price=lambda m, i, o: 0.5)
    rows = {(r.system, r.case_id, r.repetition): r for r in records.collect()}
    assert set(rows) == {(s, c, k) for s, c in (("direct", "l-1"), ("direct", "q-1"), ("direct-4b-v2", "l-1"), ("cite-v1", "q-1"), ("strange", "q-1")) for k in (1, 2)}
    assert sum(r.model_calls for r in rows.values()) == asked.value and all(len(r.model_requests or []) == r.model_calls for r in rows.values())
    one = rows["direct", "q-1", 1]
    assert one.model_calls == 1 and one.cost_usd == 0.5 and one.models == ["m1"] and one.tokens_in > 10 and one.latency_ms >= 0 and one.error is None
    assert rows["direct-4b-v2", "l-1", 2].error == "TimeoutError: slow" and rows["direct-4b-v2", "l-1", 2].output == "" and "no dataflow" in rows["strange", "q-1", 1].error
    # a draft and the first of its sentences, then the limit
    assert rows["cite-v1", "q-1", 1].model_calls == 2
    order = [(r.system, r.repetition, r.case_id) for r in sorted(rows.values(), key=lambda r: r.ord)]
    assert order == sorted(order)
    graded = {(r.run.system, r.run.caseId, r.run.repetition): r for r in R.graded_records(records, cases, gold).collect()}
    assert [g.grader for g in graded["direct", "q-1", 1].grades] == ["citation-precision", "citation-recall"] and graded["direct", "q-1", 1].status == "ok"
    assert graded["direct", "l-1", 1].status == "grade_error" and graded["direct-4b-v2", "l-1", 1].status == "run_error" and graded["direct-4b-v2", "l-1", 1].grades[0].detail == "run error: TimeoutError: slow"
    assert graded["direct", "q-1", 1].judge.modelCalls == 0


def test_choice_of_systems_and_suites(tables):
    systems, cases, _ = tables
    with pytest.raises(ValueError, match="unknown systems: nobody"):
        R.run_records(systems, cases, names=["nobody"])
    with pytest.raises(ValueError, match="no jobs"):
        R.run_records(systems, cases, names=["cite-v1"], suites=["legalbench"])
    assert {r.case_id for r in R.run_records(systems, cases, names=["direct"], suites=["asqa"]).collect()} == {"q-1"}
    assert R.dataflow_of("direct-4b-ft") == "direct" and R.dataflow_of("review-ft-v3") == "review-ft" and R.dataflow_of("scan-v2") == "review-v1" and R.dataflow_of("x") is None


def test_recall_after_precision_asks_nothing_new(spark, tables):
    _, cases, gold = tables
    asked = spark.sparkContext.accumulator(0)

    def model(prompt):
        asked.add(1)
        return "yes"

    out = "The licence ends in May [1]. Nothing of note stands here [1][2]. No citation here."
    records = spark.createDataFrame([(1, "q-1", "a", 1, out, None, None), (2, "q-1", "b", 1, out, None, None)], "ord bigint, case_id string, system string, repetition int, output string, error string, model_requests array<string>")
    answers = R._answers(records, cases, gold)
    memo = J.Memo(J.model_judge(model), cases.select(F.col("id").alias("case_id"), "docs"))
    G.citation_precision(answers, memo).collect()
    first = asked.value
    # two sentences with all they cite, [1] and [2] of the second alone
    assert first == 4 and memo.usage().first().modelCalls == 4
    G.citation_recall(answers, memo).collect()
    assert asked.value == first and {r.ord: r.modelCalls for r in memo.used_by_record().collect()} == {1: 4}
    limited = J.Memo(J.model_judge(model), cases.select(F.col("id").alias("case_id"), "docs"), limit=1)
    assert [r.score for r in G.citation_recall(answers, limited).collect()] == [pytest.approx(1 / 3)] * 2 and asked.value == first + 1


def test_regrade(spark, tables):
    _, cases, gold = tables
    kinds = "ord bigint, case_id string, system string, repetition int, output string, error string, latency_ms bigint, model_calls int, tokens_in bigint, tokens_out bigint, cost_usd double, models array<string>, model_requests array<string>, findings array<string>, decision string, trace struct<source:string,transformed_source:string,raw_output:string,released_output:string>"
    stored = spark.createDataFrame([(1, "l-1", "a", 1, "Yes", *[None] * 11), (2, "gone", "a", 1, "Yes", *[None] * 11)], kinds)
    graded, missing = R.regrade(stored, cases, gold)
    row = graded.first()
    assert graded.count() == 1 and row.grades[0].grader == "exact" and row.grades[0]["pass"] and [tuple(r) for r in missing.collect()] == [(2, "gone")]
    m = R.regrade_manifest({"runId": "r1", "expectedJobs": 2, "complete": True, "records": 2}, 1, "j2", "now")
    assert m == {"regradeOf": "r1", "expectedJobs": 2, "complete": False, "records": 1, "judgeModel": "j2", "finishedAt": "now"}
    assert R.judge_of(None, "b", {"JUDGE_MODEL": "e"}) == "b" and R.judge_of("o", "b", {}) == "o" and R.judge_of(None, None, {"JUDGE_MODEL": "e"}) == "e" and R.judge_of(None, None, {}) is None


def test_gateway_refuses(spark, tables):
    _, cases, _ = tables
    rows = cases.withColumn("id", job_id(F.lit("s"), F.col("id"), F.lit(1)))
    gate = Gateway(lambda m, p: "x", routes={"s": {"main": "m9"}}, allowed=frozenset(["m1"]))
    out = S.direct(rows, gate).collect()
    assert {r.error for r in out} == {"PermissionError: model m9 is not allowed"} and {r.model_calls for r in out} == {0}


def test_resolving_graders(spark):
    b = spark.createDataFrame([("x", ["exact", "own"], "x/g"), ("y", ["own", "who"], "y/g")], "name string, graders array<string>, module string")
    out = {(r.benchmark, r.grader): (r.known, r.clash) for r in R.resolve_graders(b, G.REGISTRY).collect()}
    assert out == {("x", "exact"): (True, False), ("x", "own"): (False, True), ("y", "own"): (False, True), ("y", "who"): (False, False)}
