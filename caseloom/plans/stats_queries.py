"""Statistics as queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import LCG_A, LCG_C, LCG_SEED, RESAMPLES, grade_cell, percent, points
from ..operators import stats
from .session import cut_lineage
from .views import CASES_SQL, GRADED_SQL, RECORDS_SQL, graded, records, table

SUMS = ["errors", "latency_ms", "tokens_in", "tokens_out", "model_calls", "cost_usd", "judge_calls", "judge_tokens_in", "judge_tokens_out", "judge_cost_usd"]


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded so that the last bit of a sum, which depends on the order of adding, doesn't decide a tie."""
    return F.round(x + 10.0 ** -(digits + 3), digits)


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"round(({x}) + 1e-{digits + 3}, {digits})"


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def agg1_summary(spark: SparkSession, d: str) -> DataFrame:
    g = graded(spark, d)
    both = stats.summary(g).join(stats.consistency(g), stats.KEY)
    return _round(both, *SUMS, "consistency")


def agg2_grader_rates(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.grader_rates(graded(spark, d)), "pass_rate", "mean_score")


def agg5_consistency(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.consistency(graded(spark, d)), "consistency")


def agg6_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost with token rates of 1 and 2 per million where no provider reported one."""
    return _round(stats.summary(graded(spark, d), 1.0, 2.0).select(*stats.KEY, "cost_usd"), "cost_usd", digits=9)


def agg8_case_means(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.case_means(graded(spark, d)), "mean_score")


def agg9_paired(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.paired(stats.paired_differences(graded(spark, d))), "mean_diff")


def agg11_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.bootstrap(stats.paired_differences(graded(spark, d))), "low", "high")


def agg12_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return stats.first_seen(graded(spark, d), ["suite", "system"], "first_ord")


def agg14_usage(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    return r.groupBy("run_id").agg(F.sum("model_calls").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), rounded(F.sum("cost_usd")).alias("cost_usd"))


def agg15_total_cost(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.total_cost(stats.summary(graded(spark, d))), "total_cost_usd", digits=5)


def agg16_models_used(spark: SparkSession, d: str) -> DataFrame:
    return stats.models_used(records(spark, d))


def agg16_judges_used(spark: SparkSession, d: str) -> DataFrame:
    return stats.judges_used(graded(spark, d))


def agg18_completeness(spark: SparkSession, d: str) -> DataFrame:
    return stats.completeness(table(spark, d, "runs").dropDuplicates(["run_id"]), records(spark, d))


def agg19_extent(spark: SparkSession, d: str) -> DataFrame:
    g = graded(spark, d)
    return g.groupBy("suite").agg(F.max("repetition").alias("repetitions"), F.count_distinct("case_id").alias("cases"), F.count_distinct("system").alias("systems"))


def agg20_best_flags(spark: SparkSession, d: str) -> DataFrame:
    g = cut_lineage(graded(spark, d))
    flags = stats.best_flags(stats.metric_rows(stats.summary(g), stats.grader_rates(g), stats.consistency(g)))
    return _round(flags, "value", digits=5).drop("higher")


def agg21_unequal_runs(spark: SparkSession, d: str) -> DataFrame:
    return stats.unequal_runs(stats.summary(graded(spark, d)))


def agg22_failures(spark: SparkSession, d: str) -> DataFrame:
    return stats.failures(graded(spark, d))


def prj9_status(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("ord", stats.status_of(F.col("status"), F.col("error")).alias("status"))


def rpt1_pivot(spark: SparkSession, d: str) -> DataFrame:
    """The report's table: a row per suite, task and system, a column per grader."""
    rates = stats.grader_rates(graded(spark, d)).withColumn("cell", grade_cell(rounded(F.col("pass_rate"), 9), rounded(F.col("mean_score"), 9)))
    return rates.groupBy(*stats.KEY).pivot("grader", list(GRADERS)).agg(F.first("cell")).select(*stats.KEY, *[F.coalesce(f"`{g}`", F.lit("n/a")).alias(g.replace("-", "_")) for g in GRADERS])


def rpt1_paired_points(spark: SparkSession, d: str) -> DataFrame:
    p = stats.paired(stats.paired_differences(graded(spark, d)))
    return p.select("suite", "grader", "a", "b", points(rounded(F.col("mean_diff"), 9)).alias("mean_diff"), F.format_string("%d/%d/%d", "wins", "ties", "losses").alias("wtl"))


def mth3_percent(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(graded(spark, d)).select(*stats.KEY, percent(rounded(F.col("errors"), 9)).alias("errors"), stats.rounded_seconds(rounded(F.col("latency_ms"))).alias("latency_s"))


def win7_rank(spark: SparkSession, d: str) -> DataFrame:
    r = stats.grader_rates(graded(spark, d)).where("task = 'ALL'")
    return r.select("suite", "system", "grader", rounded(F.col("mean_score") * 10 + F.col("pass_rate")).alias("rank_key"))


GRADERS = ("exact", "str-em", "citation-recall", "citation-precision", "clause-recall", "clause-precision", "citation-support", "removal", "leakage", "retention")

_QUERIES = (
    agg1_summary, agg2_grader_rates, agg5_consistency, agg6_cost, agg8_case_means, agg9_paired, agg11_bootstrap, agg12_first_seen, agg14_usage, agg15_total_cost, agg16_models_used,
    agg16_judges_used, agg18_completeness, agg19_extent, agg20_best_flags, agg21_unequal_runs, agg22_failures, prj9_status, rpt1_pivot, rpt1_paired_points, mth3_percent, win7_rank,
)
QUERIES = {f.__name__: f for f in _QUERIES}

_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_STATUS = "coalesce(status, CASE WHEN error IS NOT NULL AND error <> '' THEN 'run_error' ELSE 'ok' END)"
_SUMMARY = f"""
  SELECT suite, CASE WHEN grouping(task) = 1 THEN 'ALL' ELSE task END AS task, system, count(*) AS n,
         avg(CASE WHEN {_STATUS} <> 'ok' THEN 1.0::DOUBLE ELSE 0.0 END) AS errors, avg(latency_ms) AS latency_ms, avg(tokens_in) AS tokens_in, avg(tokens_out) AS tokens_out,
         avg(model_calls) AS model_calls, CASE WHEN max(cost_usd) > 0 THEN avg(coalesce(cost_usd, 0)) {{rated}} END AS cost_usd,
         avg(coalesce(judge.modelCalls, 0)) AS judge_calls, avg(coalesce(judge.tokensIn, 0)) AS judge_tokens_in, avg(coalesce(judge.tokensOut, 0)) AS judge_tokens_out,
         CASE WHEN max(coalesce(judge.costUsd, 0)) > 0 THEN avg(coalesce(judge.costUsd, 0)) END AS judge_cost_usd
  FROM g GROUP BY GROUPING SETS ((suite, task, system), (suite, system))"""
_CONSISTENCY = f"""
  SELECT suite, CASE WHEN grouping(task) = 1 THEN 'ALL' ELSE task END AS task, system, CASE WHEN max(runs) > 1 THEN avg(share) END AS consistency FROM (
    SELECT suite, task, system, case_id, CAST(max(c) AS DOUBLE) / sum(c) AS share, sum(c) AS runs FROM (
      SELECT suite, task, system, case_id, coalesce(grades[1].extracted, regexp_replace(coalesce(output, ''), '^{_WS}+|{_WS}+\\z', '', 'g')) AS answer, count(*) AS c FROM g GROUP BY ALL) GROUP BY ALL)
  GROUP BY GROUPING SETS ((suite, task, system), (suite, system))"""
_LONG = "SELECT ord, suite, task, system, case_id, repetition, error, place - 1 AS place, grades[place] AS gr FROM (SELECT *, unnest(generate_series(1, len(grades))) AS place FROM g)"
_RATES = """
  SELECT suite, CASE WHEN grouping(task) = 1 THEN 'ALL' ELSE task END AS task, system, gr.grader AS grader, count(*) AS n, avg(CAST(gr.pass AS INTEGER)) AS pass_rate, avg(gr.score) AS mean_score
  FROM long GROUP BY GROUPING SETS ((suite, task, system, gr.grader), (suite, system, gr.grader))"""
_DIFFS = """
  m AS (SELECT suite, gr.grader AS grader, system, case_id, avg(gr.score) AS s FROM long GROUP BY ALL HAVING avg(gr.score) IS NOT NULL),
  so AS (SELECT suite, system, min(ord) AS so FROM g GROUP BY ALL), co AS (SELECT suite, case_id, min(ord) AS case_ord FROM g GROUP BY ALL),
  mm AS (SELECT m.*, so.so FROM m JOIN so USING (suite, system)),
  diffs AS (SELECT a.suite, a.grader, a.system AS a, b.system AS b, a.case_id, case_ord, a.s - b.s AS d FROM mm a JOIN mm b ON a.suite = b.suite AND a.grader = b.grader AND a.case_id = b.case_id AND (a.so < b.so OR a.so = b.so AND a.system < b.system)
            JOIN co ON co.suite = a.suite AND co.case_id = a.case_id)"""
_PAIRED = "SELECT suite, grader, a, b, count(*) AS n, count_if(d > 1e-9) AS wins, count_if(abs(d) <= 1e-9) AS ties, count_if(d < -1e-9) AS losses, avg(d) AS mean_diff FROM diffs GROUP BY ALL"
_G = f"WITH g AS {GRADED_SQL}"
_GL = f"{_G}, long AS ({_LONG})"


def _states(limit_bits: int) -> str:
    """CTEs s0, s1, ...: the generator's states by doubling; the last has 2 ** limit_bits of them."""
    a, c, parts = LCG_A, LCG_C, [f"s0 AS (SELECT 1 AS k, {(LCG_SEED * LCG_A + LCG_C) % 2**32}::HUGEINT AS s)"]
    for i in range(limit_bits):
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT k, s FROM s{i} UNION ALL SELECT k + {2**i}, (s * {a}::HUGEINT + {c}::HUGEINT) % 4294967296::HUGEINT FROM s{i})")
        a, c = a * a % 2**32, (a * c + c) % 2**32
    return ", ".join(parts)


_PCT = "CAST(CAST(floor({x} * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'"
_CELL = f"CASE WHEN abs(p - s) > 0.005 THEN {_PCT.format(x='p')} || ' (avg ' || {_PCT.format(x='s')} || ')' ELSE {_PCT.format(x='p')} END"

ORACLE = {
    "agg1_summary": f"{_G}, su AS ({_SUMMARY.format(rated='')}), co AS ({_CONSISTENCY}) SELECT suite, task, system, n, {', '.join(f'{rounded_sql(c)} AS {c}' for c in SUMS)}, round((consistency) + 1e-9, 6) AS consistency FROM su JOIN co USING (suite, task, system)",
    "agg2_grader_rates": f"{_GL} SELECT suite, task, system, grader, n, round((pass_rate) + 1e-9, 6) AS pass_rate, round((mean_score) + 1e-9, 6) AS mean_score FROM ({_RATES})",
    "agg5_consistency": f"{_G} SELECT suite, task, system, round((consistency) + 1e-9, 6) AS consistency FROM ({_CONSISTENCY})",
    "agg6_cost": f"{_G} SELECT suite, task, system, round((cost_usd) + 1e-12, 9) AS cost_usd FROM ({_SUMMARY.format(rated='ELSE avg((tokens_in * 1.0::DOUBLE + tokens_out * 2.0::DOUBLE) / 1e6)')})",
    "agg8_case_means": f"{_GL} SELECT suite, gr.grader AS grader, system, case_id, round((avg(gr.score)) + 1e-9, 6) AS mean_score FROM long GROUP BY ALL",
    "agg9_paired": f"{_GL}, {_DIFFS} SELECT suite, grader, a, b, n, wins, ties, losses, round((mean_diff) + 1e-9, 6) AS mean_diff FROM ({_PAIRED})",
    "agg11_bootstrap": f"""{_GL}, {_DIFFS}, {_states(18)},
      xs AS MATERIALIZED (SELECT suite, grader, a, b, list(d ORDER BY case_ord, case_id) AS d, count(*) AS n FROM diffs GROUP BY ALL),
      draws AS MATERIALIZED (SELECT n, r, list(CAST(floor(CAST(s AS DOUBLE) / 4294967296 * n) AS INTEGER) + 1 ORDER BY k) AS places FROM (SELECT n, (k - 1) // n AS r, k, s FROM (SELECT DISTINCT n FROM xs) JOIN s18 ON k <= n * {RESAMPLES}) GROUP BY n, r),
      means AS (SELECT suite, grader, a, b, n, r, list_sum(list_transform(places, lambda i: d[i])) / n AS m FROM xs JOIN draws USING (n)),
      sorted AS (SELECT suite, grader, a, b, n, list_sort(list(m)) AS m FROM means GROUP BY ALL)
      SELECT suite, grader, a, b, n, round((m[26]) + 1e-9, 6) AS low, round((m[975]) + 1e-9, 6) AS high FROM sorted""",
    "agg12_first_seen": f"{_G} SELECT suite, system, min(ord) AS first_ord FROM g GROUP BY ALL",
    "agg14_usage": f"SELECT run_id, CAST(sum(model_calls) AS BIGINT) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round((sum(cost_usd)) + 1e-9, 6) AS cost_usd FROM {RECORDS_SQL} GROUP BY ALL",
    "agg15_total_cost": f"{_G} SELECT suite, task, system, n, round((n * (cost_usd + coalesce(judge_cost_usd, 0))) + 1e-8, 5) AS total_cost_usd FROM ({_SUMMARY.format(rated='')})",
    "agg16_models_used": f"SELECT system, model, CAST(row_number() OVER (PARTITION BY system ORDER BY seen, model) AS INTEGER) AS place FROM (SELECT system, models[p] AS model, min({{'o': ord, 'p': p}}) AS seen FROM (SELECT system, ord, models, unnest(generate_series(1, len(models))) AS p FROM {RECORDS_SQL}) GROUP BY ALL)",
    "agg16_judges_used": f"{_G} SELECT suite, judge, count(*) AS records FROM (SELECT suite, unnest(judge.models) AS judge FROM g) GROUP BY ALL",
    "agg18_completeness": f"SELECT u.run_id, u.expected_jobs AS expected, coalesce(n, 0) AS records, coalesce(coalesce(n, 0) = u.expected_jobs, FALSE) AS complete FROM runs u LEFT JOIN (SELECT run_id, count(*) AS n FROM {RECORDS_SQL} GROUP BY ALL) r USING (run_id)",
    "agg19_extent": f"{_G} SELECT suite, max(repetition) AS repetitions, count(DISTINCT case_id) AS cases, count(DISTINCT system) AS systems FROM g GROUP BY ALL",
    "agg20_best_flags": f"""{_GL}, su AS ({_SUMMARY.format(rated='')}), co AS ({_CONSISTENCY}), l AS (SELECT * FROM su JOIN co USING (suite, task, system) WHERE task = 'ALL'),
      m AS (SELECT suite, system, unnest([{{'m': 'error rate', 'v': errors, 'h': FALSE}}, {{'m': 'consistency', 'v': consistency, 'h': TRUE}}, {{'m': 'latency s', 'v': latency_ms / 1000, 'h': FALSE}}, {{'m': 'model calls per run', 'v': model_calls, 'h': FALSE}},
            {{'m': 'harness cost per run', 'v': cost_usd, 'h': FALSE}}, {{'m': 'judge cost per run', 'v': judge_cost_usd, 'h': FALSE}}, {{'m': 'total cost', 'v': n * (cost_usd + coalesce(judge_cost_usd, 0)), 'h': FALSE}}]) AS x FROM l),
      rows AS (SELECT suite, system, x.m AS metric, x.v AS value, x.h AS higher FROM m UNION ALL SELECT suite, system, grader, mean_score * 10 + pass_rate, TRUE FROM ({_RATES}) WHERE task = 'ALL')
      SELECT suite, system, metric, round((value) + 1e-8, 5) AS value, coalesce(count(value) OVER w > 1 AND abs(value - CASE WHEN higher THEN max(value) OVER w ELSE min(value) OVER w END) < 1e-9, FALSE) AS best FROM rows WINDOW w AS (PARTITION BY suite, metric)""",
    "agg21_unequal_runs": f"{_G} SELECT suite, min(n) AS fewest, max(n) AS most, min(n) <> max(n) AS unequal FROM (SELECT suite, system, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL",
    "agg22_failures": f"{_GL} SELECT ord, case_id, system, repetition, CAST(place AS INTEGER) AS place, gr.grader AS grader, gr.detail AS detail, error FROM long WHERE NOT gr.pass",
    "prj9_status": f"SELECT ord, {_STATUS} AS status FROM {RECORDS_SQL}",
    "rpt1_pivot": f"{_GL}, c AS (SELECT suite, task, system, grader, round((pass_rate) + 1e-12, 9) AS p, round((mean_score) + 1e-12, 9) AS s FROM ({_RATES})) SELECT suite, task, system, {', '.join(f'''coalesce(max(CASE WHEN grader = '{g}' THEN {_CELL} END), 'n/a') AS {g.replace('-', '_')}''' for g in GRADERS)} FROM c GROUP BY suite, task, system",
    "rpt1_paired_points": f"{_GL}, {_DIFFS}, p AS ({_PAIRED}) SELECT suite, grader, a, b, CASE WHEN round((mean_diff) + 1e-12, 9) >= 0 THEN '+' ELSE '−' END || CAST(CAST(abs(floor(round((mean_diff) + 1e-12, 9) * 100 + 0.5)) AS BIGINT) AS VARCHAR) AS mean_diff, wins || '/' || ties || '/' || losses AS wtl FROM p",
    "mth3_percent": f"{_G} SELECT suite, task, system, {_PCT.format(x='round((errors) + 1e-12, 9)')} AS errors, floor(round((latency_ms) + 1e-9, 6) / 100 + 0.5) / 10 AS latency_s FROM ({_SUMMARY.format(rated='')})",
    "win7_rank": f"{_GL} SELECT suite, system, grader, round((mean_score * 10 + pass_rate) + 1e-9, 6) AS rank_key FROM ({_RATES}) WHERE task = 'ALL'",
}
_ = CASES_SQL
