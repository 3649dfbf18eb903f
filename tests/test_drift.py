"""Drifting schemas: the report of changes, typed rows, rescued members and their replay."""

import json

from caseloom.operators.drift import changes, flat_members, ingest, json_kind, parse_object, promotions, replay, replay_value


def lines(spark, files, collector="c"):
    rows = [(collector, seq, f"{collector}/{seq}/{name}", i + 1, x if isinstance(x, str) else json.dumps(x)) for seq, name, content in files for i, x in enumerate(content)]
    return spark.createDataFrame(rows, "collector string, seq int, file_name string, line_no int, line string")


def found(df):
    return {(r.seq, r.kind, r.scope, r.member, r.change, r.new_member) for r in df.collect()}


def rec(status="ok", **run):
    return {"run": {"caseId": "a-1", **run}, "status": status}


def test_every_change(spark):
    files = [
        (1, "results.jsonl", [rec(), rec("run_error"), '{"run": {"caseId": "cut', ""]),
        (2, "results.jsonl", [{"run": {"caseId": "a-2", "seed": 120590}, "run_status": "ok"}] * 2),
        (4, "results.jsonl", [{"run": {"caseId": "a-3", "seed": 1.5}, "run_status": 3}]),
        (5, "results.jsonl", [{"run": {"caseId": "a-3", "seed": None}, "run_status": None}]),
        (6, "results.jsonl", [{"run": {"caseId": "a-3"}}]),
        (1, "run.json", [{"runId": "x", "providers": {"m": {"baseUrl": "http://u-1.invalid/v1"}}}]),
        (3, "run.json", [{"runId": "y", "providers": [{"model": "m", "baseUrl": "http://u-2.invalid/v1"}], "notes": []}]),
    ]
    assert found(changes(lines(spark, files))) == {
        (2, "results", "", "status", "renamed", "run_status"),
        (2, "results", "run", "seed", "added", None),
        (4, "results", "", "run_status", "retyped", None),
        (4, "results", "run", "seed", "retyped", None),
        (6, "results", "", "run_status", "removed", None),
        (6, "results", "run", "seed", "removed", None),
        (3, "run", "", "providers", "retyped", None),
        (3, "run", "", "notes", "added", None),
    }


def test_unlike_content_is_no_rename(spark):
    files = [(1, "results.jsonl", [rec(requests=["Question 1 on X: cite passage 2"])]), (2, "results.jsonl", [rec(labels=["blue"])])]
    assert found(changes(lines(spark, files))) == {(2, "results", "run", "requests", "removed", None), (2, "results", "run", "labels", "added", None)}


def test_two_like_members_renamed_in_one_file(spark):
    # both old members and both new ones resemble the first of the other side most
    files = [(1, "results.jsonl", [rec(a1="alpha beta gamma", a2="alpha beta delta")]), (2, "results.jsonl", [rec(b1="alpha beta gamma", b2="alpha beta omega")])]
    assert found(changes(lines(spark, files))) == {(2, "results", "run", "a1", "renamed", "b1"), (2, "results", "run", "a2", "renamed", "b2")}


def test_empty_and_other_columns(spark):
    df = lines(spark, [(1, "run.json", [{"a": 1}])]).selectExpr("*", "1 as kind", "2 as members")
    assert changes(df).count() == 0 and changes(df.where("false")).count() == 0


def test_kinds():
    assert [json_kind(x) for x in (1, 1.0, True, "", {}, None, [], [1, 2.5], [1, "a", None])] == ["integer", "fraction", "boolean", "string", "object", None, None, "array<fraction>", "array<integer|string>"]
    assert parse_object('{"a": 1} x') is None and parse_object('{"a": NaN}') is None and parse_object("[1]") is None and parse_object(None) is None
    assert parse_object('{"a": 1, "a": 2}') == {"a": 2}


def test_rescue_and_replay(spark):
    target = {"run.caseId": "string", "status": "string", "run.modelRequests": "array<string>", "run.n": "bigint"}
    files = [(1, "results.jsonl", [rec("ok", n=3, extra={"a": [1]}), {"run": {"caseId": "b", "n": "x"}, "run_status": 2}, "broken", {"run": None, "status": {"code": "ok"}}])]
    src = lines(spark, files)
    rows = {r.line_no: r for r in ingest(src, target).collect()}
    assert set(rows) == {1, 2, 4} and rows[1].n == 3 and json.loads(rows[1].rescued) == {"run.extra": {"a": [1]}}
    assert rows[2].n is None and json.loads(rows[2].rescued) == {"run.n": "x", "run_status": 2}
    # a replay works on what was ingested, there are no lines any more
    table = ingest(src, target).drop("line")
    again = {r.line_no: r for r in replay(table, target, {"status": ["run_status"]}).collect()}
    assert again[1] == rows[1].__class__(**{k: v for k, v in rows[1].asDict().items() if k != "line"}) and replay(table, target, {}).where("status is not null").count() == 2
    assert again[2].status == "2" and json.loads(again[2].rescued)["run_status"] == 2 and again[4].status == "ok"
    assert replay_value("one", "array<string>") == ["one"] and replay_value(["m"], "map<string,string>") == [("m", None)] and replay_value([1], "bigint") is None


def test_promotions_follow_names(spark):
    df = spark.createDataFrame([("results", "", "status", "renamed", "outcome"), ("results", "", "outcome", "renamed", "state"), ("results", "run", "x", "added", None)], "kind string, scope string, member string, change string, new_member string")
    assert promotions(df, "results", {"status": "string"}) == {"status": ["outcome", "state"]}
    assert promotions(df, "results", {"status": "string"}, approved={"outcome"}) == {"status": ["outcome"]} and promotions(df.where("false"), "run", {"status": "string"}) == {}


def test_members_by_path():
    assert flat_members({"a": 1, "run": {"b": 2}, "run.b": 3}) == {"a": 1, "run": {"b": 2}, "run.b": 2, ".run.b": 3} and flat_members({"run": None}) == {"run": None}


def test_a_renamed_run_and_files_without_readable_lines(spark):
    long = {"caseId": "a-1", "output": "the council paid for the bridge"}
    files = [(1, "results.jsonl", [{"run": long}]), (2, "results.jsonl", [{"record": long}]), (3, "results.jsonl", ["cut"]), (4, "results.jsonl", [{"record": long}])]
    gone = {(2, "results", "run", m, "removed", None) for m in long}
    assert found(changes(lines(spark, files))) == gone | {(2, "results", "", "run", "renamed", "record"), (3, "results", "", "record", "removed", None), (4, "results", "", "record", "added", None)}
