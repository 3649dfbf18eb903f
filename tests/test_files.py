"""Case files, manifests, stored runs, corpora, sinks, reports and connectors on small folders."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from caseloom.operators import stats
from caseloom.plans import report
from caseloom.sources import connectors, files, sinks
from caseloom.sources.rows_api import RowsApi


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def case(root, suite, cid, public=None, private=None):
    put(root / suite / "cases" / f"{cid}.public.json", {"id": cid, "suite": suite, "task": "t", "instructions": "i", "input": "x"} | (public or {}))
    put(root / suite / "cases" / f"{cid}.private.json", {"id": cid, "graders": ["exact"], "answer": "Yes"} | (private or {}))


def test_cases(spark, tmp_path):
    case(tmp_path, "s", "s-001", {"choices": ["Yes", "No"]})
    case(tmp_path, "s", "s-002", {"docs": [{"title": "T", "text": "x"}]}, {"clauses": []})
    got = {r.id: r for r in files.load_cases(spark, str(tmp_path)).collect()}
    assert set(got) == {"s-001", "s-002"} and got["s-002"].clauses == [] and got["s-001"].clauses is None and got["s-001"].choices == ["Yes", "No"]
    case(tmp_path, "s", "s-003", {"suite": "other"})
    case(tmp_path, "s", "s-004", {"id": "s-001"}, {"graders": []})
    put(tmp_path / "s" / "cases" / "s-005.public.json", "{broken")
    found = {r.problem for r in files.case_problems(files.public_cases(spark, str(tmp_path)), files.private_cases(spark, str(tmp_path))).collect()}
    assert {"suite is not the folder's", "id is not the file's name", "id is not unique", "not a case", "no graders", "no public half"} <= found
    with pytest.raises(ValueError, match="s-003"):
        files.load_cases(spark, str(tmp_path))


def test_manifests(spark, tmp_path):
    put(tmp_path / "a" / "harness.json", {"name": "a", "entry": "e.ts", "suites": ["s"], "models": {"main": "m"}, "providers": {"z": {"baseUrl": "u"}}})
    put(tmp_path / "b" / "harness.json", {"name": "b", "entry": "e.ts", "suites": ["s"], "models": {"main": "m"}, "image": "own"})
    put(tmp_path / "s" / "benchmark.json", {"name": "s", "graders": ["exact"], "judge": {"model": "j"}})
    h = files.harnesses(spark, str(tmp_path))
    assert {(r.name, r.image) for r in h.collect()} == {("a", "bench-sandbox"), ("b", "own")}
    assert [(r.name, r.problem) for r in files.harness_problems(h).collect()] == [("a", "provider of no model")]
    assert files.benchmarks(spark, str(tmp_path)).first().judge.model == "j"
    assert files.subdirectories(spark, str(tmp_path)) == ["a", "b", "s"] and files.subdirectories(spark, str(tmp_path / "none")) == []


def test_project(spark, tmp_path):
    put(tmp_path / "harnesses" / "a" / "harness.json", {"name": "a", "entry": "e.ts", "suites": ["s", "lost"], "models": {"main": "m"}})
    put(tmp_path / "harnesses" / "b" / "harness.json", {"name": "b", "suites": ["s"], "models": {"main": "m"}})
    put(tmp_path / "benchmarks" / "s" / "benchmark.json", {"name": "s", "graders": ["exact"]})
    case(tmp_path / "benchmarks", "s", "s-001")
    case(tmp_path / "benchmarks", "s", "s-002", private={"graders": []})
    p = files.project(spark, str(tmp_path))
    assert p.systems.count() == 2 and p.benchmarks.count() == 1 and p.public.count() == p.private.count() == 2
    assert {(r.what.split("/")[-1], r.problem) for r in p.problems.collect()} == {("b", "no entry"), ("a", "unknown suite lost"), ("s-002.private.json", "no graders")}


def record(i, **run):
    return {"run": {"caseId": f"s-00{i}", "system": "a", "repetition": 1, "output": "Yes", "latencyMs": 5, "modelRequests": ["p"], "trace": {"source": "x", "rawOutput": "y"}} | run, "grades": [{"grader": "exact", "pass": i % 2 == 0, "score": 1.0 - i % 2, "detail": "d"}]}


def test_stored_runs_and_pins(spark, tmp_path):
    put(tmp_path / "r1.jsonl", "\n".join(json.dumps(record(i)) for i in range(3)) + '\n{"run": {"caseId": "cut')
    put(tmp_path / "r2.jsonl", json.dumps(record(7)) + "\n{}\n")
    r = files.stored_runs(spark, str(tmp_path / "r1.jsonl"), str(tmp_path / "r2.jsonl"))
    assert r.count() == 4 and r.where("status is null and judge is null").count() == 4
    m = str(tmp_path / "run.json")
    sinks.start_manifest(spark, m, {"runId": "x", "expectedJobs": 4, "git": {"dirty": ["a.py"]}})
    with pytest.raises(ValueError):
        sinks.pin_run(spark, m, r, str(tmp_path / "pin"))
    assert sinks.finish_manifest(spark, m, 4, "now")["complete"] is True
    assert "a.py" in sinks.pin_run(spark, m, r, str(tmp_path / "pin"))["warning"]
    back = spark.read.json(str(tmp_path / "pin" / "results.jsonl"))
    assert back.count() == 4 and "modelRequests" not in back.schema["run"].dataType.names and back.first().run.trace.rawOutput == "y"
    with pytest.raises(Exception, match="exist"):
        sinks.pin_run(spark, m, r, str(tmp_path / "pin"))
    sinks.rewrite_records(r.drop("file_path"), str(tmp_path / "again"), ["run.caseId"])
    sinks.append_records(r.drop("file_path"), str(tmp_path / "again"))
    assert spark.read.json(str(tmp_path / "again")).count() == 8


def test_corpora(spark, tmp_path):
    put(tmp_path / "c.json", {"data": [{"title": "T", "paragraphs": [{"context": "abc", "qas": [{"id": "T__Exit Notice", "question": "Highlight.\nDetails: what?", "answers": [{"text": "b", "answer_start": 1}]}]}]}]})
    c = files.contracts(spark, str(tmp_path / "c.json")).first()
    assert (c.title, c.context, c.qas[0].category, c.qas[0].details) == ("T", "abc", "Exit Notice", "what?")
    put(tmp_path / "r.json", [{"question": "q", "docs": [{"title": " A  b ", "text": "1"}, {"title": "B", "text": "2"}], "qa_pairs": [{"question": "p", "short_answers": ["s"]}]}])
    r = files.retrieval(spark, str(tmp_path / "r.json"), 1).first()
    assert r.place == 0 and r.file_path.endswith("r.json")
    assert len(r.docs) == 1 and r.docs[0].title == "A b" and r.qaPairs[0].shortAnswers == ["s"]
    with pytest.raises(ValueError):
        files.checked_binary(spark, str(tmp_path / "c.json"), "0" * 64)


def test_rows_api(spark, tmp_path):
    put(tmp_path / "0.json", {"rows": [{"row": {"index": i, "text": f"t{i}", "answer": "Yes"}} for i in range(100)]})
    put(tmp_path / "100.json", {"rows": [{"row": {"index": 100, "text": "last", "answer": "No"}}]})
    spark.dataSource.register(RowsApi)
    df = spark.read.format("rows_api").option("url", f"file://{tmp_path}/{{offset}}.json").option("rows", 101).load()
    assert df.count() == 101 and df.where("answer = 'No'").first().idx == 100


def test_settings(monkeypatch):
    monkeypatch.setenv("CASELOOM_X", "  ")
    assert files.setting("CASELOOM_X", "d") == "d"
    with pytest.raises(KeyError):
        files.secret("CASELOOM_X")
    assert files.code_state("/")[1] == []


def test_processes(spark):
    echo = [sys.executable, "-c", "import json,sys,os; c=json.load(sys.stdin); print(json.dumps({'output': c['input'] + str(len(os.environ) < 9)}))"]
    assert connectors.run_process(echo, {"input": "a"}) == {"output": "aTrue"}
    assert "timed out" in connectors.run_process([sys.executable, "-c", "import time; time.sleep(9)"], {}, 0.5)["error"]
    assert "exited 3" in connectors.run_process([sys.executable, "-c", "raise SystemExit(3)"], {})["error"]
    assert "no JSON" in connectors.run_process([sys.executable, "-c", "print('x')"], {})["error"] and "start" in connectors.run_process(["/nowhere"], {})["error"]
    df = spark.createDataFrame([("c", "in")], "id string, input string")
    assert connectors.process_system(df, echo).first().output == "inTrue"
    assert connectors.docker_argv("img", "n", "e.js", {"A": "1"})[-3:] == ["img", "node", "e.js"]


def test_gateway():
    g = connectors.Gateway({"m": lambda p: "a b"}, 2, price=lambda i, o: 0.5)
    g.ask("m", "one two three")
    with pytest.raises(PermissionError):
        g.ask("x", "p")
    g.ask("m", "p")
    with pytest.raises(connectors.LimitReached):
        g.ask("m", "p")
    assert g.usage() == {"modelCalls": 2, "tokensIn": 4, "tokensOut": 4, "costUsd": 1.0, "models": ["m"]} and g.requests == ["one two three", "p"]


def test_report(spark):
    from tests.test_stats import records

    rows = [{"system": s, "case": f"c{i}", "score": float(i % 2 == (s == "a")), "task": t} for s in "ab" for i in range(4) for t in ("t",)]
    g = records(spark, rows)
    t = report.tables(g)
    fails = stats.failures(g).orderBy("ord").collect()
    text = report.markdown("r1", t, {"exact": "labels match"}, 9, 8, fails, details=False)
    assert "Incomplete: 8 of 9" in text and "| ALL | a | 4 |" in text and "## Failures (4)" in text and "- exact: labels match" in text
    best = stats.best_flags(stats.metric_rows(stats.summary(g), stats.grader_rates(g), stats.consistency(g))).collect()
    page = report.page("R <1>", t, best)
    assert "<svg" in page and "R &lt;1&gt;" in page and "<b>" in page
    html = report.markdown_to_html("# A\n\n- x **y**\n- `z`\n\n| a | b |\n| --- | --- |\n| 1 | [l](u) |\n\ntext <x>")
    assert html.startswith("<h1>A</h1>") and "<ul><li>x <b>y</b></li><li><code>z</code></li></ul>" in html and "<td>1</td>" in html and "&lt;x&gt;" in html and "---" not in html
    with pytest.raises(ValueError):
        report.bars("x", ["g"], [str(i) for i in range(9)], {})
    assert report.wrapped_label("personal_jurisdiction test") == ["personal", "jurisdiction test"] and report.wrapped_label("short one") == ["short one"]
    assert "r1/chart.html" in report.site_index([("r1", "s", 3, 1)])
    assert sinks.chart_name(2) == "chart-merged.html"
    assert sinks.progress_line(g.select("system", "case_id", "repetition", "grades")).where(F.col("line").contains("exact")).count() == 8


def test_tables_are_released(spark):
    from caseloom.plans.session import cut_lineage, release_tables

    release_tables(spark)
    kept = cut_lineage(spark.range(3))
    assert kept.count() == 3 and release_tables(spark) == 1 and release_tables(spark) == 0
    with pytest.raises(Exception):  # noqa: B017
        kept.count()
