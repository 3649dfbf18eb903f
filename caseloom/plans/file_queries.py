"""Sinks and sources as round trips: what is written comes back, each beside its SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import latest_by
from ..sources import files, sinks
from .session import shared_path
from .views import RECORDS_SQL, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Every record once, in the stored form."""
    return latest_by(table(spark, d, "results").select("ord", "run", "grades", "judge", "status", "loaded_at"), ["ord"], "loaded_at", ["run", "grades", "judge", "status"], wide=True)


_RUN = "case_id, system, repetition, output, latency_ms, cost_usd, CAST(coalesce(len(grades), 0) AS INTEGER) AS grades, status"


def _flat(stored: DataFrame) -> DataFrame:
    run = {"case_id": "run.caseId", "system": "run.system", "repetition": "run.repetition", "output": "run.output", "latency_ms": "run.latencyMs", "cost_usd": "run.costUsd"}
    return stored.select(*[F.col(p).alias(c) for c, p in run.items()], F.size("grades").alias("grades"), "status")


@_query(f"SELECT {_RUN} FROM {RECORDS_SQL}")
def snk1_appended_records(spark: SparkSession, d: str) -> DataFrame:
    """Records appended in two writes, read back as one stored run."""
    path, records = shared_path(spark, "run"), _stored(spark, d).drop("ord")
    failed = F.coalesce(F.col("run.error"), F.lit("")) != ""
    sinks.append_records(records.where(failed), path)
    sinks.append_records(records.where(~failed), path)
    return _flat(files.stored_runs(spark, path))


@_query(f"SELECT {_RUN} FROM {RECORDS_SQL} UNION ALL SELECT {_RUN} FROM {RECORDS_SQL} WHERE error IS NOT NULL AND error <> ''")
def src6_merged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two stored runs read as one: all records, and those that failed once more."""
    one, two, records = shared_path(spark, "run"), shared_path(spark, "run"), _stored(spark, d).drop("ord")
    sinks.append_records(records, one)
    sinks.append_records(records.where(F.coalesce(F.col("run.error"), F.lit("")) != ""), two)
    return _flat(files.stored_runs(spark, one, two))


@_query(f"SELECT {_RUN} FROM {RECORDS_SQL}")
def snk2_rewritten_records(spark: SparkSession, d: str) -> DataFrame:
    """A run rewritten in its order."""
    path = shared_path(spark, "run")
    sinks.rewrite_records(_stored(spark, d), path, ["ord"])
    return _flat(files.stored_runs(spark, path))


@_query("SELECT run_id, expected_jobs AS expected, CAST(records AS BIGINT) AS records, records = expected_jobs AS complete FROM runs WHERE expected_jobs IS NOT NULL AND records IS NOT NULL")
def snk3_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Every run's manifest written before and completed after the run; a manifest a run is what a run has."""
    runs = table(spark, d, "runs").where("expected_jobs is not null and records is not null").select("run_id", "expected_jobs", "records").collect()  # settings
    root = shared_path(spark, "manifests")
    for r in runs:
        sinks.start_manifest(spark, f"{root}/{r.run_id}/run.json", {"runId": r.run_id, "expectedJobs": r.expected_jobs})
        sinks.finish_manifest(spark, f"{root}/{r.run_id}/run.json", r.records, "end")
    made = spark.read.schema("runId string, expectedJobs bigint, records bigint, complete boolean").option("multiLine", True).option("recursiveFileLookup", True).json(root)
    return made.select(F.col("runId").alias("run_id"), F.col("expectedJobs").alias("expected"), "records", "complete")
