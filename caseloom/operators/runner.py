"""Runs: manifests and cases to graded records, and stored records to new grades.

A run joins the job grid, the systems' dataflows and the graders. Systems are rows of manifests: the dataflow of a system is
named by its manifest's entry (or by its name without the version), its models, limits and repetitions are parameters. All
systems with the same dataflow go through it together, so a run has as many dataflows as there are kinds of systems.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut_lineage
from . import graders as G
from . import grid
from . import judge as J
from .gateway import Gateway, job_id
from .systems import SYSTEMS, scripted

#: A system's calls a job where its manifest names no limit, and a run's questions to the judge.
MAX_CALLS, MAX_JUDGED = 20, 100
#: Manifests are settings; more rows than this are a mistake.
MAX_MANIFESTS = 10_000
# fixed values: which dataflow the variants of a system are rows of
VARIANTS = {"direct-4b": "direct", "direct-4b-ft": "direct", "guarded": "placeholder", "scan": "review-v1", "review": "review-v1", "cite": "cite-v1", "legal": "legal-v1"}


def dataflow_of(name: str, flows: dict[str, Callable[..., DataFrame]] | None = None) -> str | None:
    """The dataflow that a manifest's name stands for: its own name, or that of its family; None if there is none."""
    flows = flows or SYSTEMS
    family = re.sub(r"-v\d+$", "", name)
    return next((x for x in (name, family, VARIANTS.get(name), VARIANTS.get(family)) if x in flows), None)


def _manifests(systems: DataFrame, names: Sequence[str] | None) -> list:
    columns = [c for c in ("name", "suites", "models", "maxCalls") if c in systems.columns]
    chosen = systems if names is None else systems.where(F.col("name").isin(*names))
    rows = chosen.select(*columns).limit(MAX_MANIFESTS + 1).collect()
    if len(rows) > MAX_MANIFESTS:
        raise ValueError(f"more than {MAX_MANIFESTS} systems")
    missing = set(names or ()) - {r.name for r in rows}
    if missing:
        raise ValueError(f"unknown systems: {', '.join(sorted(missing))}")
    return rows


def run_records(
    systems: DataFrame, cases: DataFrame, reps: int = 1, ask: Callable[[str, str], str] = lambda model, prompt: scripted(prompt), names: Sequence[str] | None = None,
    suites: Sequence[str] | None = None, price: Callable[[str, int, int], float | None] = lambda m, i, o: None, flows: dict[str, Callable[..., DataFrame]] | None = None,
) -> DataFrame:
    """The ungraded records of a run in the order of systems, repetitions and cases: ord, case_id, system, repetition, output,
    error, latency_ms, model_calls, tokens_in, tokens_out, cost_usd, models, model_requests, findings, decision, trace.

    names, suites: what to run, all if None; unknown names and suites without a job are errors. ask: (model, prompt) -> reply.
    A system that no dataflow fits gives records with an error. A failing job is an error in its record, never of the run.
    """
    flows = flows or SYSTEMS
    rows = _manifests(systems, names)
    chosen = cases if suites is None else cases.where(F.col("suite").isin(*suites))
    jobs = grid.job_grid(systems.where(F.col("name").isin(*[r.name for r in rows])), chosen, reps)
    jobs = jobs.select(job_id(F.col("system"), F.col("case_id"), F.col("repetition")).alias("id"), "system", "case_id", "repetition")
    if suites is not None and jobs.isEmpty():
        raise ValueError(f"no jobs on {', '.join(suites)}")
    kinds: dict[str | None, list] = {}
    for r in rows:
        kinds.setdefault(dataflow_of(r.name, flows), []).append(r)
    made = None
    for kind, members in sorted(kinds.items(), key=lambda x: str(x[0])):
        own = jobs.where(F.col("system").isin(*[r.name for r in members]))
        if kind is None:
            none = F.lit(None)
            part = own.select("id", F.lit("").alias("output"), F.lit("no dataflow for this system").alias("error"), F.array().cast("array<string>").alias("findings"), F.lit("pass").alias("decision"), none.cast("struct<source:string,transformed_source:string,raw_output:string,released_output:string>").alias("trace"))
            part = part.select("*", F.lit(0).alias("model_calls"), *[none.cast(t).alias(c) for c, t in (("tokens_in", "bigint"), ("tokens_out", "bigint"), ("cost_usd", "double"), ("latency_ms", "bigint"), ("models", "array<string>"), ("model_requests", "array<string>"))])
        else:
            names_of = {r.name: dict(r.models or {}) for r in members if "models" in r}
            limits = {r.name: int(r.maxCalls) for r in members if "maxCalls" in r and r.maxCalls is not None}
            gate = Gateway(ask, routes=names_of, limits=limits, max_calls=MAX_CALLS, allowed=frozenset(m for x in names_of.values() for m in x.values()) or None, price=price)
            given = own.select("id", "case_id").join(chosen.withColumnRenamed("id", "case_id"), "case_id").drop("case_id")
            part = flows[kind](given, gate).drop("system")
        part = jobs.join(part, "id").drop("id")
        made = part if made is None else made.unionByName(part)
    if made is None:
        raise ValueError("no systems")
    order = made.select("system", "case_id").distinct()
    places = grid.canonical_order(order.withColumn("repetition", F.lit(1))).select("system", "case_id", "system_ord", "case_ord")
    # the place in the canonical order, without sorting everything in one task: system, repetition, case
    ordered = made.join(places, ["system", "case_id"])
    return ordered.select(((F.col("system_ord").cast("bigint") * reps + F.col("repetition") - 1) * F.lit(1 << 32) + F.col("case_ord")).alias("ord"), *[c for c in made.columns])


def graded_records(records: DataFrame, cases: DataFrame, gold: DataFrame, judge: J.Judge | J.Memo = J.lexical) -> DataFrame:
    """Records in the stored form: ord, run, grades (in the order their case lists them), judge, status.

    status is run_error, grade_error (a grade couldn't be made) or ok. The judge's use counts, at the record that asked first,
    the questions really put; it is 0 where the judge is no model.
    """
    memo = judge if isinstance(judge, J.Memo) else J.Memo(judge, cases.select(F.col("id").alias("case_id"), "docs"))
    answers = cut_lineage(_answers(records, cases, gold))
    made = G.dispatch(answers, judge=memo)
    grade = F.struct("place", F.struct("grader", "pass", "score", "extracted", "detail").alias("g"), "status")
    per = made.groupBy("ord").agg(F.array_sort(F.collect_list(grade)).alias("x"))
    used = memo.used_by_record()
    zero = F.struct(F.lit(0).cast("bigint").alias("modelCalls"), F.lit(0).cast("bigint").alias("tokensIn"), F.lit(0).cast("bigint").alias("tokensOut"))
    both = records.join(per, "ord", "left")
    both = both.withColumn("judge", zero) if used is None else both.join(used.select("ord", F.struct("modelCalls", "tokensIn", "tokensOut").alias("judge")), "ord", "left").withColumn("judge", F.coalesce("judge", zero))
    trace = F.struct(*[F.col(f"trace.{a}").alias(b) for a, b in (("source", "source"), ("transformed_source", "transformedSource"), ("raw_output", "rawOutput"), ("released_output", "releasedOutput"))], F.array(F.struct(F.col("system").alias("name"), F.lit("run").alias("mode"), "findings", "decision")).alias("stages"))
    run = F.struct(
        F.col("case_id").alias("caseId"), "system", "repetition", "output", F.col("latency_ms").alias("latencyMs"), "error", F.col("model_calls").cast("bigint").alias("modelCalls"), F.col("tokens_in").alias("tokensIn"),
        F.col("tokens_out").alias("tokensOut"), F.col("cost_usd").alias("costUsd"), "models", F.col("model_requests").alias("modelRequests"), trace.alias("trace"),
    )
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    lost = F.exists(F.coalesce("x", F.array().cast(both.schema["x"].dataType)), lambda g: g["status"] == "grade_error")
    status = F.when(failed, "run_error").when(lost, "grade_error").otherwise("ok")
    grades = F.transform(F.coalesce("x", F.array().cast(both.schema["x"].dataType)), lambda g: g["g"])
    return both.select("ord", run.alias("run"), grades.alias("grades"), "judge", status.alias("status"))


def _answers(records: DataFrame, cases: DataFrame, gold: DataFrame) -> DataFrame:
    both = cases.join(gold, "id").withColumnRenamed("id", "case_id")
    run = records.select("ord", "case_id", "system", "repetition", "output", "error", "model_requests")
    return run.join(both, "case_id")


def regrade(records: DataFrame, cases: DataFrame, gold: DataFrame, judge: J.Judge | J.Memo = J.lexical) -> tuple[DataFrame, DataFrame]:
    """Stored outputs by today's graders: the graded records (see `graded_records`), and ord and case_id of those whose case is
    gone, which keep no grades."""
    known = cases.select(F.col("id").alias("case_id"))
    missing = records.select("ord", "case_id").join(known, "case_id", "left_anti").select("ord", "case_id")
    return graded_records(records.join(known, "case_id", "left_semi"), cases, gold, judge), missing


def regrade_manifest(manifest: dict, records: int, judge_model: str | None = None, regraded_at: str | None = None) -> dict:
    """The manifest of a regraded run: that of the run it comes from, under `regradeOf`, with its own number of records and,
    if it was changed, the judge."""
    out = {k: v for k, v in manifest.items() if k not in ("runId", "finishedAt")}
    out |= {"regradeOf": manifest.get("runId"), "records": records, "complete": records == manifest.get("expectedJobs", records)}
    if judge_model:
        out["judgeModel"] = judge_model
    if regraded_at:
        out["finishedAt"] = regraded_at
    return out


def judge_of(override: str | None, benchmark: str | None, env: dict[str, str]) -> str | None:
    """The judge's model: what the run asks for, else the benchmark's, else the environment's; None if nobody names one."""
    return next((x for x in (override, benchmark, env.get("JUDGE_MODEL")) if x), None)


def first_named(*names: Column) -> Column:
    """The same choice over columns: the first name that is neither NULL nor blank."""
    return F.coalesce(*[F.when(F.trim(n) != "", n) for n in names])


def resolve_graders(benchmarks: DataFrame, registry: dict[str, object]) -> DataFrame:
    """benchmark, grader, known, clash: the graders that benchmarks list, whether one of that name is registered, and whether
    several benchmarks bring different ones (column `module`, if there is one) under it."""
    module = F.col("module") if "module" in benchmarks.columns else F.lit(None).cast("string")
    flat = benchmarks.select(F.col("name").alias("benchmark"), F.explode_outer("graders").alias("grader"), module.alias("module"))
    per = flat.where("module is not null").groupBy("grader").agg(F.count_distinct("module").alias("n"))
    return flat.join(per, "grader", "left").select("benchmark", "grader", F.col("grader").isin(*registry).alias("known"), (F.coalesce("n", F.lit(0)) > 1).alias("clash"))
