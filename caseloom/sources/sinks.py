"""Writers of records, manifests, case pairs, reports and pinned runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import slim


def _text(spark: SparkSession, path: str, content: str | None = None) -> str | None:
    """Write a small text file on any file system Spark writes, or read one (None if it isn't there)."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc.hadoopConfiguration())
    if content is None:
        if not fs.exists(p):
            return None
        s = fs.open(p)
        try:
            return bytes(b & 0xFF for b in s.readAllBytes()).decode("utf-8")
        finally:
            s.close()
    out = fs.create(p, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()
    return None


def append_records(records: DataFrame, path: str) -> None:
    """Append records as JSON lines; each call adds files, so rows written before a failure stay."""
    records.write.mode("append").json(path)


def rewrite_records(records: DataFrame, path: str, order: list[str]) -> None:
    """Replace a run's records, sorted; files follow the order."""
    records.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def start_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write a run's manifest before the run: incomplete, no records."""
    _text(spark, path, json.dumps(manifest | {"complete": False, "records": 0}, ensure_ascii=False, indent=1))


def finish_manifest(spark: SparkSession, path: str, records: int, finished_at: str) -> dict:
    """Complete a manifest after the run: complete if all expected records are there."""
    m = json.loads(_text(spark, path) or "{}")
    m |= {"records": records, "finishedAt": finished_at, "complete": records == m.get("expectedJobs")}
    _text(spark, path, json.dumps(m, ensure_ascii=False, indent=1))
    return m


def write_report(spark: SparkSession, path: str, text: str) -> None:
    _text(spark, path, text)


def write_case_pairs(public: DataFrame, private: DataFrame, folder: str) -> None:
    """Public and private halves in separate places, by suite; existing ones are not overwritten."""
    public.write.mode("errorifexists").partitionBy("suite").json(f"{folder}/public")
    private.write.mode("errorifexists").json(f"{folder}/private")


def pin_run(spark: SparkSession, manifest_path: str, records: DataFrame, target: str) -> dict:
    """Store a complete run's records slimmed, once: an incomplete run and one that is pinned already are errors. The result
    has a warning for code that differed from its commit."""
    m = json.loads(_text(spark, manifest_path) or "{}")
    if not m.get("complete"):
        raise ValueError("the run is not complete")
    slim(records).write.mode("errorifexists").json(f"{target}/results.jsonl")
    _text(spark, f"{target}/run.json", json.dumps(m, ensure_ascii=False, indent=1))
    dirty = (m.get("git") or {}).get("dirty") or []
    return {"pinned": target, "warning": f"code differed from its commit: {', '.join(dirty)}" if dirty else None}


def chart_name(runs: int) -> str:
    return "chart-merged.html" if runs > 1 else "chart.html"


def progress_line(record: DataFrame) -> DataFrame:
    """One line of progress a record."""
    marks = F.array_join(F.transform("grades", lambda g: F.concat(g["grader"], F.when(g["pass"], "+").otherwise("-"))), " ")
    return record.select(F.concat_ws(" ", "system", "case_id", F.concat(F.lit("#"), "repetition"), marks).alias("line"))
