"""Statistics over graded records: summaries, consistency, cost, paired comparisons with bootstrap intervals.

A graded record has: ord (the canonical order), case_id, suite, task, system, repetition, output, error, latency_ms,
model_calls, tokens_in, tokens_out, cost_usd, models, grades, judge, status. Rows whose case is unknown are left out before.
NULL means "not reported" and never counts as 0, except where a rule says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import LCG_SEED, RESAMPLES, half_up, lcg_states
from ..functions.text import strip

TIE = 1e-9
KEY = ["suite", "task", "system"]


def status_of(status: Column, error: Column) -> Column:
    """The status; of old records without one, run_error if they have an error text, else ok."""
    return F.coalesce(status, F.when(error.isNotNull() & (error != ""), F.lit("run_error")).otherwise(F.lit("ok")))


def _levels(df: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates per suite, task and system and, with the task ALL, per suite and system."""
    rolled = df.groupingSets([[F.col(c) for c in KEY], [F.col("suite"), F.col("system")]], *KEY).agg(F.grouping("task").alias("__all"), *aggs)
    return rolled.withColumn("task", F.when(F.col("__all") == 1, "ALL").otherwise(F.col("task"))).drop("__all")


def provider_cost(cost: Column, tokens_in: Column, tokens_out: Column, rate_in: float | None, rate_out: float | None) -> Column:
    """Mean cost: the reported ones if any is above 0, else from the token rates (per million), else NULL."""
    rated = F.lit(None).cast("double")
    if rate_in is not None or rate_out is not None:
        rated = F.avg((tokens_in * (rate_in or 0.0) + tokens_out * (rate_out or 0.0)) / 1e6)
    return F.when(F.max(cost) > 0, F.avg(F.coalesce(cost, F.lit(0.0)))).otherwise(rated)


def summary(graded: DataFrame, rate_in: float | None = None, rate_out: float | None = None) -> DataFrame:
    """Per suite, task (or ALL) and system: n, share of errors, mean latency, tokens and calls, cost, the judge's use."""
    judge = lambda f: F.avg(F.coalesce(F.col(f"judge.{f}"), F.lit(0)))
    judge_cost = F.coalesce(F.col("judge.costUsd"), F.lit(0.0))
    return _levels(
        graded,
        F.count("*").alias("n"),
        F.avg(F.when(status_of(F.col("status"), F.col("error")) != "ok", 1.0).otherwise(0.0)).alias("errors"),
        *[F.avg(c).alias(c) for c in ("latency_ms", "tokens_in", "tokens_out", "model_calls")],
        provider_cost(F.col("cost_usd"), F.col("tokens_in"), F.col("tokens_out"), rate_in, rate_out).alias("cost_usd"),
        judge("modelCalls").alias("judge_calls"),
        judge("tokensIn").alias("judge_tokens_in"),
        judge("tokensOut").alias("judge_tokens_out"),
        F.when(F.max(judge_cost) > 0, F.avg(judge_cost)).alias("judge_cost_usd"),
    )


def grades_long(graded: DataFrame) -> DataFrame:
    """One row per grade, with its place in the record."""
    flat = graded.select("ord", *KEY, "case_id", "repetition", "error", F.posexplode("grades").alias("place", "g"))
    return flat.select("ord", *KEY, "case_id", "repetition", "error", "place", "g.*")


def grader_rates(graded: DataFrame) -> DataFrame:
    """Per suite, task (or ALL), system and grader: grades, pass rate, mean score; a grader's own grades are the base."""
    long = grades_long(graded).withColumn("passed", F.col("pass").cast("int").cast("double"))
    keys = [F.col(c) for c in (*KEY, "grader")]
    rolled = long.groupingSets([keys, [F.col("suite"), F.col("system"), F.col("grader")]], *KEY, "grader").agg(F.grouping("task").alias("__all"), F.count("*").alias("n"), F.avg("passed").alias("pass_rate"), F.avg("score").alias("mean_score"))
    return rolled.withColumn("task", F.when(F.col("__all") == 1, "ALL").otherwise(F.col("task"))).drop("__all")


def consistency(graded: DataFrame) -> DataFrame:
    """Per suite, task (or ALL) and system: the mean share of the most frequent answer of a case; NULL if no case has several
    repetitions. An answer is the first grade's extracted label, else the trimmed output; failed runs answer alike."""
    answer = F.coalesce(F.get("grades", 0).getField("extracted"), strip(F.coalesce("output", F.lit(""))))
    answers = graded.select(*KEY, "case_id", answer.alias("answer")).groupBy(*KEY, "case_id", "answer").count()
    cases = answers.groupBy(*KEY, "case_id").agg((F.max("count") / F.sum("count")).alias("share"), F.sum("count").alias("runs"))
    return _levels(cases, F.when(F.max("runs") > 1, F.avg("share")).alias("consistency"))


def case_means(graded: DataFrame) -> DataFrame:
    """Per suite, grader, system and case the mean score over the repetitions."""
    return grades_long(graded).groupBy("suite", "grader", "system", "case_id").agg(F.avg("score").alias("mean_score"))


def first_seen(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys with the least ord of their rows: an order of first appearance that doesn't depend on how rows are read."""
    return df.groupBy(*keys).agg(F.min("ord").alias(name))


def paired_differences(graded: DataFrame) -> DataFrame:
    """suite, grader, a, b, case_id, case_ord, d: per case that both systems ran, mean score of a minus mean score of b; a is
    the system that was seen first in the suite."""
    means = case_means(graded).where(F.col("mean_score").isNotNull())
    systems = first_seen(graded, ["suite", "system"], "system_ord")
    cases = first_seen(graded, ["suite", "case_id"], "case_ord")
    placed = means.join(systems, ["suite", "system"])
    keys = ["suite", "grader", "case_id"]
    a = placed.select(*keys, F.col("system").alias("a"), F.col("system_ord").alias("a_ord"), F.col("mean_score").alias("sa"))
    b = placed.select(*keys, F.col("system").alias("b"), F.col("system_ord").alias("b_ord"), F.col("mean_score").alias("sb"))
    both = a.join(b, keys).where((F.col("a_ord") < F.col("b_ord")) | (F.col("a_ord") == F.col("b_ord")) & (F.col("a") < F.col("b")))
    return both.join(cases, ["suite", "case_id"]).select("suite", "grader", "a", "b", "case_id", "case_ord", (F.col("sa") - F.col("sb")).alias("d"))


def paired(differences: DataFrame) -> DataFrame:
    """Per suite, grader and pair of systems: cases, wins, ties and losses of a over b, mean difference."""
    d = F.col("d")
    return differences.groupBy("suite", "grader", "a", "b").agg(
        F.count("*").alias("n"), F.count_if(d > TIE).alias("wins"), F.count_if(F.abs(d) <= TIE).alias("ties"), F.count_if(d < -TIE).alias("losses"), F.avg("d").alias("mean_diff")
    )


#: Draws that are held at once: resamples are drawn in blocks of so many numbers, 48 MB.
BLOCK = 1 << 21


def bootstrap_interval(xs: np.ndarray, resamples: int = RESAMPLES, seed: int = LCG_SEED, block: int = BLOCK) -> tuple[float, float]:
    """The 2.5 and 97.5 percent places of the sorted means of resamples of xs, drawn block by block."""
    n = len(xs)
    means = np.empty(resamples)
    rows = max(1, block // n)
    for first in range(0, resamples, rows):
        some = min(rows, resamples - first)
        if some * n <= 2 * block:
            means[first : first + some] = xs[_draws(n, first, some, seed)].sum(1) / n
        else:  # one resample of more numbers than a block holds
            means[first] = sum(xs[_drawn(min(block, n - at), first * n + at, n, seed)].sum() for at in range(0, n, block)) / n
    means.sort()
    return float(means[int(0.025 * resamples)]), float(means[-(-975 * resamples // 1000) - 1])


def bootstrap(differences: DataFrame, resamples: int = RESAMPLES, seed: int = LCG_SEED) -> DataFrame:
    """suite, grader, a, b, n, low, high: 95 % percentile bootstrap intervals of the mean difference, reproducible.

    Every comparison draws the same stream: resample k takes the case floor(u * n) for each u of its n states. The cases are
    taken in their canonical order. A comparison's differences (one number per case) are one group; its resamples are drawn
    in blocks, so a task holds the differences and one block.
    """

    def interval(group: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((np.array(table.column("case_id").to_pylist()), table.column("case_ord").to_numpy()))
        xs = table.column("d").to_numpy()[order]
        low, high = bootstrap_interval(xs, resamples, seed)
        return pa.table([*(pa.array([g.as_py()], pa.string()) for g in group), pa.array([len(xs)], pa.int64()), pa.array([low]), pa.array([high])], ["suite", "grader", "a", "b", "n", "low", "high"])

    small = differences.select("suite", "grader", "a", "b", "case_id", "case_ord", "d")
    return small.groupBy("suite", "grader", "a", "b").applyInArrow(interval, "suite string, grader string, a string, b string, n bigint, low double, high double")


def _drawn(count: int, skip: int, n: int, seed: int) -> np.ndarray:
    return (lcg_states(count, seed, skip).astype(np.float64) / 2**32 * n).astype(np.int64)


_last: dict[tuple[int, int, int, int], np.ndarray] = {}


def _draws(n: int, first: int, count: int, seed: int) -> np.ndarray:
    """Row k: the places that resample first + k draws. Comparisons of the same size share them: one block is kept."""
    key = (n, first, count, seed)
    if key not in _last:
        _last.clear()
        _last[key] = _drawn(n * count, n * first, n, seed).reshape(count, n)
    return _last[key]


# derived figures


def total_cost(summaries: DataFrame) -> DataFrame:
    """n times the cost of a run with its judging; NULL if the cost is not known."""
    each = F.col("cost_usd") + F.coalesce("judge_cost_usd", F.lit(0.0))
    return summaries.select(*KEY, "n", (F.col("n") * each).alias("total_cost_usd"))


def models_used(graded: DataFrame) -> DataFrame:
    """system, model, place: the models of each system in the order in which they were first seen."""
    flat = graded.select("system", "ord", F.posexplode("models").alias("p", "model"))
    first = flat.groupBy("system", "model").agg(F.min(F.struct("ord", "p")).alias("seen"))
    return first.select("system", "model", F.row_number().over(Window.partitionBy("system").orderBy("seen", "model")).alias("place"))


def judges_used(graded: DataFrame) -> DataFrame:
    flat = graded.select("suite", F.explode("judge.models").alias("judge"))
    return flat.groupBy("suite", "judge").agg(F.count("*").alias("records"))


def metric_rows(summaries: DataFrame, rates: DataFrame, consistencies: DataFrame) -> DataFrame:
    """suite, system, metric, value, higher: the comparison table in long form; a grader ranks by score, then by pass rate."""
    level = summaries.where("task = 'ALL'").join(consistencies.where("task = 'ALL'").drop("task"), ["suite", "system"])
    cost = F.col("n") * (F.col("cost_usd") + F.coalesce("judge_cost_usd", F.lit(0.0)))
    named = [("error rate", F.col("errors"), False), ("consistency", F.col("consistency"), True), ("latency s", F.col("latency_ms") / 1000, False), ("model calls per run", F.col("model_calls"), False)]
    named += [("harness cost per run", F.col("cost_usd"), False), ("judge cost per run", F.col("judge_cost_usd"), False), ("total cost", cost, False)]
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(h).alias("higher")) for m, v, h in named])).alias("m")
    plain = level.select("suite", "system", entries).select("suite", "system", "m.*")
    graded = rates.where("task = 'ALL'").select("suite", "system", F.col("grader").alias("metric"), (F.col("mean_score") * 10 + F.col("pass_rate")).alias("value"), F.lit(True).alias("higher"))
    return plain.unionByName(graded)


def best_flags(metrics: DataFrame) -> DataFrame:
    """metric_rows with `best`: the best value of a metric in its suite, within 1e-9, if at least two systems have one."""
    w = Window.partitionBy("suite", "metric")
    top = F.when(F.col("higher"), F.max("value").over(w)).otherwise(F.min("value").over(w))
    return metrics.withColumn("best", F.coalesce((F.count("value").over(w) > 1) & (F.abs(F.col("value") - top) < TIE), F.lit(False)))


def unequal_runs(summaries: DataFrame) -> DataFrame:
    """Per suite whether its systems ran unequally often."""
    return summaries.where("task = 'ALL'").groupBy("suite").agg(F.min("n").alias("fewest"), F.max("n").alias("most"), (F.min("n") != F.max("n")).alias("unequal"))


def failures(graded: DataFrame, details: bool = True) -> DataFrame:
    """Failing grades in canonical order columns; without details the gold-naming detail is left out."""
    flat = grades_long(graded).where(~F.col("pass"))
    return flat.select("ord", "case_id", "system", "repetition", "place", "grader", *(["detail"] if details else []), "error")


def completeness(manifests: DataFrame, records: DataFrame) -> DataFrame:
    """run_id, expected, records, complete: whether a run's records are all there; runs without records have 0."""
    found = records.groupBy("run_id").agg(F.count("*").alias("found"))
    n = F.coalesce("found", F.lit(0))
    return manifests.join(found, "run_id", "left").select("run_id", F.col("expected_jobs").alias("expected"), n.alias("records"), F.coalesce(n == F.col("expected_jobs"), F.lit(False)).alias("complete"))


def rounded_seconds(ms: Column) -> Column:
    return half_up(ms / 100) / 10
