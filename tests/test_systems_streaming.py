"""Systems on the scripted model, and records as a stream."""

import json

from pyspark.sql import functions as F

from caseloom.operators import systems as S
from caseloom.streaming import records as R

DDL = "id string, suite string, task string, instructions string, input string, docs array<struct<title:string,text:string>>, examples array<struct<q:string,a:string>>, question string, choices array<string>"
DOCS = [("A", "The licence of the mill ends in the month of May in each of the years. More text."), ("B", "Nothing of note stands here for the reader of this long passage today."), ("C", "short")]


def cases(spark):
    text = "Question: When does it end?\n\n" + "\n".join(f"Document [{i}](Title: {t}): {x}" for i, (t, x) in enumerate(DOCS, 1))
    return spark.createDataFrame(
        [
            ("l-1", "legalbench", "t", "Decide.", "A case.", None, None, "Is it?", ["Yes", "No"]),
            ("r-1", "redaction", "pii", "Redact.", "Write to Ann Lee at a.b@c.example or 10.0.0.1.", None, None, None, None),
            ("c-1", "cuad", "cuad", "Answer.", text, DOCS, [("q", "a")], None, None),
            ("e-1", "cuad", "cuad", "Answer.", "Question: none?", [], None, None, None),
        ],
        DDL,
    )


def run(spark, name, **kw):
    return {r.id: r for r in S.SYSTEMS[name](cases(spark), **kw).collect()}


def test_direct_and_errors(spark):
    out = run(spark, "direct")
    assert out["l-1"].output in ("Yes", "No") and out["r-1"].output.startswith("Write to Ann Lee") and out["c-1"].decision == "pass"

    def broken(prompt):
        raise TimeoutError("too slow")

    bad = run(spark, "direct", model=broken)
    assert all(r.output == "" and r.error == "TimeoutError: too slow" for r in bad.values())


def test_scrubbing_systems(spark):
    p = run(spark, "placeholder")["r-1"]
    assert p.output == "Write to Ann Lee at [REDACTED] or [REDACTED]." and p.findings == ["email:a.b@c.example", "ipv4:10.0.0.1"] and p.decision == "modified" and "a.b@" not in p.trace.transformed_source
    h = run(spark, "legal-v1")["r-1"]
    assert "Ann" not in h.output and "llm:Ann Lee" in h.findings and h.model_calls == 3


def test_citing_systems(spark):
    c = run(spark, "cite-v1")["c-1"]
    assert c.findings and all(f.startswith("s") for f in c.findings) and c.model_calls == 1 + len(c.findings)
    for name in ("review-v1", "review-ft"):
        out = run(spark, name)
        r = out["c-1"]
        assert r.findings[0].startswith("3 passages scanned in 1 calls; quotations: ") and "confirmed as a quotation" in " ".join(r.findings) and "[1]" in r.output
        assert out["e-1"].findings[0].startswith("0 passages scanned in 0 calls")


def test_a_model_is_asked_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(prompt):
        seen.add(1)
        return "ok"

    out = S.direct(cases(spark), model)
    out.collect()
    out.where(F.col("id") == "l-1").collect()
    assert seen.value == 4


def rec(system, passed, error=None):
    return json.dumps({"run": {"caseId": "c", "system": system, "repetition": 1, "error": error, "modelCalls": 2, "tokensIn": 3, "tokensOut": 1, "costUsd": 0.5}, "grades": [{"grader": "exact", "pass": passed, "score": float(passed)}], "status": "ok"})


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"{i}.json").write_text("\n".join([rec("a", True), rec("b", i == 0, "x"), "{}"]))
    R.to_memory(R.running_usage(R.stream_records(spark, str(src), 1)), "usage").awaitTermination()
    assert {r.system: (r.records, r.failed, r.calls, r.cost_usd) for r in spark.table("usage").collect()} == {"a": (3, 0, 6, 1.5), "b": (3, 3, 6, 1.5)}
    R.to_memory(R.running_rates(R.stream_records(spark, str(src))), "rates").awaitTermination()
    assert {r.system: round(r.pass_rate, 3) for r in spark.table("rates").collect()} == {"a": 1.0, "b": 0.333}
    for _ in range(2):  # a second start goes on where the first ended
        R.store(R.stream_records(spark, str(src), 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    R.to_memory(R.once(R.stream_records(spark, str(src)), ["system", "case_id", "repetition"]), "single", "append").awaitTermination()
    assert spark.table("single").count() == 2


def test_windows(spark, tmp_path):
    spark.sql("select timestamp_ntz'2026-01-01 00:01:00' + make_dt_interval(0, 0, cast(id * 7 as int)) as ts from range(10)").write.parquet(str(tmp_path / "e"))
    e = spark.readStream.schema("ts timestamp_ntz").parquet(str(tmp_path / "e"))
    R.to_memory(R.windowed_counts(e, "ts", "30 minutes", "1 hour"), "w").awaitTermination()
    assert sum(r.n for r in spark.table("w").collect()) == 10
