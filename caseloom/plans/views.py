"""The project's tables as the operators expect them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import latest_by

RUN_COLUMNS = {
    "case_id": "run.caseId", "system": "run.system", "repetition": "run.repetition", "output": "run.output", "error": "run.error", "latency_ms": "run.latencyMs",
    "model_calls": "run.modelCalls", "tokens_in": "run.tokensIn", "tokens_out": "run.tokensOut", "cost_usd": "run.costUsd", "models": "run.models", "model_requests": "run.modelRequests",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Every record once (its latest load), flat."""
    raw = table(spark, d, "results").select("ord", "run_id", "loaded_at", *[F.col(p).alias(c) for c, p in RUN_COLUMNS.items()], "grades", "judge", "status")
    return latest_by(raw, ["ord"], "loaded_at")


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Every case once (its latest import)."""
    return latest_by(table(spark, d, "public_cases"), ["id"], "imported_at").drop("imported_at")


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Records whose case is known, with its suite and task."""
    known = latest_by(table(spark, d, "public_cases"), ["id"], "imported_at", ["suite", "task"])
    return records(spark, d).join(known.withColumnRenamed("id", "case_id"), "case_id")


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "private_cases")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Records beside their case and gold: what graders read."""
    both = cases(spark, d).join(gold(spark, d), "id").withColumnRenamed("id", "case_id")
    run = records(spark, d).select("ord", "case_id", "system", "repetition", "output", "error", "model_requests")
    return run.join(both, "case_id")


# The same views for the oracle.
RECORDS_SQL = """(SELECT ord, run_id, run.caseId AS case_id, run.system AS system, run.repetition AS repetition, run.output AS output, run.error AS error, run.latencyMs AS latency_ms,
  run.modelCalls AS model_calls, run.tokensIn AS tokens_in, run.tokensOut AS tokens_out, run.costUsd AS cost_usd, run.models AS models, run.modelRequests AS model_requests, grades, judge, status
  FROM results QUALIFY row_number() OVER (PARTITION BY ord ORDER BY loaded_at DESC) = 1)"""
CASES_SQL = "(SELECT * FROM public_cases QUALIFY row_number() OVER (PARTITION BY id ORDER BY imported_at DESC) = 1)"
GRADED_SQL = f"(SELECT r.*, c.suite, c.task FROM {RECORDS_SQL} r JOIN {CASES_SQL} c ON r.case_id = c.id)"
ANSWERS_SQL = f"""(SELECT r.ord, r.case_id, r.system, r.repetition, r.output, r.error, r.model_requests, c.suite, c.task, c.instructions, c.input, c.docs, c.examples, c.question, c.choices,
  p.graders, p.answer, p.qaPairs, p.clauses, p.protected FROM {RECORDS_SQL} r JOIN {CASES_SQL} c ON r.case_id = c.id JOIN private_cases p ON p.id = c.id)"""
