"""The general problems of training data on the project's tables: nested records (4) and drifting schemas (5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import latest_by
from ..operators.drift import TARGETS, changes, changes_of, ingest, promotions, replay, with_file_kind
from ..operators.nested import flatten, within
from .session import cut_lineage

STAGES, FINDINGS = "run_trace_stages", "run_trace_stages_findings"


def _records(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    return latest_by(spark.read.parquet(f"{d}/results.parquet"), ["ord"], "loaded_at", columns, wide=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = flatten(_records(spark, d, ["run"]), ["ord"], only={STAGES, FINDINGS})
    found = within(t[FINDINGS].select("ord", "pre", "post", "place"), t[STAGES], ["ord"], {"place": "stage_no"})
    return found.select("ord", "stage_no", F.col("place").alias("finding_no"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return flatten(_records(spark, d), ["ord"], only={"records"})["records"]


def p4_grades(spark: SparkSession, d: str) -> DataFrame:
    return flatten(_records(spark, d), ["ord"], only={"grades"})["grades"]


def p4_stages(spark: SparkSession, d: str) -> DataFrame:
    return flatten(_records(spark, d, ["run"]), ["ord"], only={STAGES})[STAGES]


def p4_findings(spark: SparkSession, d: str) -> DataFrame:
    t = flatten(_records(spark, d, ["run"]), ["ord"], only={STAGES, FINDINGS})
    return within(t[FINDINGS], t[STAGES], ["ord"], {"place": "stage_no", "name": "stage"})


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/raw_lines.parquet")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = changes(_raw(spark, d))
    return found.select("collector", "seq", F.concat_ws(".", "kind", "member").alias("field"), "change")


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    return changes(_raw(spark, d))


def _promoted(spark: SparkSession, d: str, kind: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The ingested lines of one kind of file, read once, and the approved promotions: every name that a target's member was
    renamed to or from is approved here."""
    lines = with_file_kind(_raw(spark, d)).where(F.col("kind") == kind).drop("kind")
    table = cut_lineage(ingest(lines, TARGETS[kind], members=True).drop("line"))
    found = changes_of(table, lines, TARGETS[kind], kind)
    return table, promotions(found, kind, TARGETS[kind])


def _ingested(spark: SparkSession, d: str, kind: str) -> DataFrame:
    table, promoted = _promoted(spark, d, kind)
    one = latest_by(table.drop("members"), ["collector", "seq", "file_name", "line_no"], "loaded_at")
    return replay(one, TARGETS[kind], promoted)


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d, "results")


def p5_manifests(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d, "run")


def p5_promotions(spark: SparkSession, d: str) -> DataFrame:
    """kind, member, names: the approved list behind `p5_records` and `p5_manifests`."""
    rows = [(kind, p, names) for kind in TARGETS for p, names in _promoted(spark, d, kind)[1].items()]
    return spark.createDataFrame(rows, "kind string, member string, names array<string>")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p4_found, p4_records, p4_grades, p4_stages, p4_findings, p5_found, p5_changes, p5_records, p5_manifests, p5_promotions)
}

#: The latest load of each record, with the numbers that its arrays use up.
_LATEST = "(SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY ord ORDER BY loaded_at DESC) = 1)"
_SIZED = f"""(SELECT *, run.trace.stages AS stages, coalesce(len(run.models), 0) + coalesce(len(run.modelRequests), 0) AS before,
    coalesce(list_sum(list_transform(run.trace.stages, lambda s: CASE WHEN s IS NULL THEN 1 ELSE 1 + coalesce(len(s.findings), 0) END)), 0) AS within, coalesce(len(grades), 0) AS graded, coalesce(len(judge.models), 0) AS judged FROM {_LATEST})"""
_STAGES = f"""(SELECT ord, stages, stage_no, CAST(2 + before + coalesce(list_sum(list_transform(stages[1:stage_no - 1], lambda s: CASE WHEN s IS NULL THEN 1 ELSE 1 + coalesce(len(s.findings), 0) END)), 0) AS INTEGER) AS pre
    FROM (SELECT *, unnest(generate_series(1, len(stages))) AS stage_no FROM {_SIZED}))"""
_FINDINGS = f"(SELECT ord, stage_no, pre, stages[stage_no].name AS stage, stages[stage_no].findings AS findings, unnest(generate_series(1, len(stages[stage_no].findings))) AS finding_no FROM {_STAGES})"
_LABELS = "CAST({pre} AS INTEGER) AS pre, CAST({post} AS INTEGER) AS post, {depth} AS depth, CAST({parent} AS INTEGER) AS parent_pre, CAST({place} AS INTEGER) AS place"
_RUN = ("caseId", "system", "repetition", "output", "latencyMs", "error", "modelCalls", "tokensIn", "tokensOut", "costUsd")

ORACLE: dict[str, str] = {
    "p4_found": f"SELECT ord, CAST(stage_no AS INTEGER) AS stage_no, CAST(finding_no AS INTEGER) AS finding_no FROM {_FINDINGS} WHERE findings[finding_no] IS NOT NULL",
    "p4_records": f"""SELECT ord, {_LABELS.format(pre='1', post='1 + before + within + graded + judged', depth='0', parent='NULL', place='1')}, run_id, {', '.join(f'run.{c} AS run_{c}' for c in _RUN)},
        {', '.join(f'run.trace.{c} AS run_trace_{c}' for c in ('source', 'transformedSource', 'rawOutput', 'releasedOutput'))}, {', '.join(f'judge.{c} AS judge_{c}' for c in ('modelCalls', 'tokensIn', 'tokensOut', 'costUsd'))}, status, loaded_at FROM {_SIZED}""",
    "p4_grades": f"""SELECT ord, {_LABELS.format(pre='1 + before + within + k', post='before + within + k', depth='1', parent='1', place='k')}, {', '.join(f'grades[k].{c} AS {c}' for c in ('grader', 'pass', 'score', 'extracted', 'detail'))}
        FROM (SELECT *, unnest(generate_series(1, len(grades))) AS k FROM {_SIZED}) WHERE grades[k] IS NOT NULL""",
    "p4_stages": f"""SELECT ord, {_LABELS.format(pre='pre', post='pre - 1 + coalesce(len(stages[stage_no].findings), 0)', depth='1', parent='1', place='stage_no')}, {', '.join(f'stages[stage_no].{c} AS {c}' for c in ('name', 'module', 'version', 'policy', 'mode', 'decision'))}
        FROM {_STAGES} WHERE stages[stage_no] IS NOT NULL""",
    "p4_findings": f"SELECT ord, {_LABELS.format(pre='pre + finding_no', post='pre + finding_no - 2', depth='2', parent='pre', place='finding_no')}, findings[finding_no] AS value, CAST(stage_no AS INTEGER) AS stage_no, stage FROM {_FINDINGS} WHERE findings[finding_no] IS NOT NULL",
}
