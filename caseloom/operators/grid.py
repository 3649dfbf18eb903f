"""The job grid of a run, its limits and routes, and regrading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import numbered

def runs_suite(suites: Column, suite: Column) -> Column:
    """Whether a system with these suites runs a suite; one that lists none runs all."""
    return suites.isNull() | F.array_contains(suites, suite)


def job_grid(systems: DataFrame, cases: DataFrame, reps: int) -> DataFrame:
    """system, repetition, case_id, suite: every system on every case of its suites, `reps` times.

    An equi-join on the suite: systems are unfolded by the suites they list; those without a list by all suites there are.
    """
    suites = cases.select("suite").distinct()
    listed = systems.where("suites is not null").select(F.col("name").alias("system"), F.explode(F.array_distinct("suites")).alias("suite"))
    every = systems.where("suites is null").select(F.col("name").alias("system")).withColumn("one", F.lit(1)).join(suites.withColumn("one", F.lit(1)), "one").drop("one")
    wanted = listed.unionByName(every)
    jobs = cases.select(F.col("id").alias("case_id"), "suite").join(wanted, "suite")
    return jobs.select("system", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("repetition"), "case_id", "suite")


def canonical_order(jobs: DataFrame) -> DataFrame:
    """jobs with system_ord, case_ord: the places by which runs are ordered (system, repetition, case); a case's place is that
    among the cases of its system. Systems are settings; cases are numbered range by range, whatever a system's share."""
    systems = jobs.select("system").distinct().withColumn("system_ord", F.dense_rank().over(Window.orderBy("system")))
    pairs = numbered(jobs.select("system", "case_id").distinct(), ["case_id"], "case_ord", ["system"])
    return jobs.join(systems, "system").join(pairs.withColumn("case_ord", F.col("case_ord").cast("int")), ["system", "case_id"])


def over_limit(requests: DataFrame, key: str, order: str, limit: Column) -> DataFrame:
    """requests with `call` (from 1, per key) and `allowed`: whether it is within the limit."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return requests.withColumn("call", n).withColumn("allowed", F.col("call") <= limit)


def gate(token_known: Column, route_allowed: Column, model_allowed: Column, within_limit: Column) -> Column:
    """The status of a request: 401 unknown token, 404 unknown route, 403 model not allowed, 429 limit reached, 200."""
    return F.when(~token_known, 401).when(~route_allowed, 404).when(~model_allowed, 403).when(~within_limit, 429).otherwise(200)


def upstream(models: Column, providers: Column, role: str, default: str) -> Column:
    """Where a model's requests go: its own provider, else the default."""
    return F.coalesce(F.try_element_at(providers, F.try_element_at(models, F.lit(role))).getField("baseUrl"), F.lit(default))


def unknown(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Wanted keys that nobody knows."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def slim(records: DataFrame) -> DataFrame:
    """Records without their requests and the texts before and after the input stage."""
    return records.withColumn("run", F.col("run").dropFields("modelRequests", "trace.source", "trace.transformedSource"))
