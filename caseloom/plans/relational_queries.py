"""Selections, joins, windows, sorts, limits and sets of the engine as queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.numbers import SHUFFLE_SEED, lcg_states
from ..operators import dataset as D
from ..operators import graders as G
from ..operators import grid
from ..operators import runner as R
from ..operators import systems as S
from ..operators.judge import Memo
from .session import cut_lineage
from .text_queries import cites_sql, collapse_sql, findings_sql, flexible_sql, norm_sql, scrub_sql, sentences_sql, strip_sql, uncite_sql
from .views import ANSWERS_SQL, CASES_SQL, GRADED_SQL, RECORDS_SQL, answers, cases, gold, graded, records, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
WS = X.WS


def _query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# projections


@_query(f"SELECT id, list_transform(docs[1:2], lambda x: x.title) AS titles, len(docs[1:2]) AS n FROM {CASES_SQL} WHERE docs IS NOT NULL")
def prj1_first_docs(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).where("docs is not null").withColumn("top", F.slice("docs", 1, 2))
    return c.select("id", F.transform("top", lambda x: x["title"]).alias("titles"), F.size("top").cast("bigint").alias("n"))


@_query("SELECT id, list_transform(qaPairs, lambda p: p.question || ' = ' || array_to_string(p.shortAnswers, '/')) AS pairs FROM private_cases WHERE qaPairs IS NOT NULL")
def prj2_qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).where("qaPairs is not null").select("id", F.transform("qaPairs", lambda p: F.concat(p["question"], F.lit(" = "), F.array_join(p["shortAnswers"], "/"))).alias("pairs"))


@_query(rf"SELECT id, regexp_extract(input, 'contract [\"“«„]?\s?([A-Z_ ]+)', 1) AS contract, string_split(id, '-')[-1] AS number FROM {CASES_SQL} WHERE suite = 'cuad'".replace('\\"', '"'))
def prj3_category(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).where("suite = 'cuad'")
    return c.select("id", F.regexp_extract("input", r'contract ["“«„]?\s?([A-Z_ ]+)', 1).alias("contract"), F.element_at(F.split("id", "-"), -1).alias("number"))


@_query("SELECT name, coalesce(image, 'sandbox') AS image, coalesce(maxCalls, 20) AS max_calls, coalesce(models['safety'], models['main']) AS safety FROM systems")
def prj4_defaults(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "systems")
    safety = F.coalesce(F.try_element_at("models", F.lit("safety")), F.try_element_at("models", F.lit("main")))
    return s.select("name", F.coalesce("image", F.lit("sandbox")).alias("image"), F.coalesce("maxCalls", F.lit(20)).cast("bigint").alias("max_calls"), safety.alias("safety"))


@_query("SELECT ord, loaded_at, run.caseId AS case_id, run.trace.rawOutput AS raw_output, run.trace.releasedOutput AS released_output, len(run.trace.stages) AS stages, status FROM results")
def prj6_slim_records(spark: SparkSession, d: str) -> DataFrame:
    s = grid.slim(table(spark, d, "results"))
    return s.select("ord", "loaded_at", F.col("run.caseId").alias("case_id"), F.col("run.trace.rawOutput").alias("raw_output"), F.col("run.trace.releasedOutput").alias("released_output"), F.when(F.col("run.trace.stages").isNotNull(), F.size("run.trace.stages")).cast("bigint").alias("stages"), "status")


@_query(f"SELECT (SELECT array_to_string(list_sort(list(DISTINCT suite)), '+') FROM {CASES_SQL}) AS suite, system, count(*) AS n FROM {GRADED_SQL} GROUP BY ALL")
def prj7_combined_suite(spark: SparkSession, d: str) -> DataFrame:
    # a row per suite: a handful
    name = cases(spark, d).select(F.array_join(F.array_sort(F.collect_set("suite")), "+").alias("suite"))
    return graded(spark, d).groupBy("system").agg(F.count("*").alias("n")).crossJoin(F.broadcast(name)).select("suite", "system", "n")


@_query("SELECT run_id, coalesce(nullif(trim(providers.judgeBaseUrl), ''), nullif(trim(providers.baseUrl), ''), 'environment') AS judge FROM runs")
def prj8_judge(spark: SparkSession, d: str) -> DataFrame:
    """The chain of a run's judge: its own, else the run's provider, else the environment's."""
    return table(spark, d, "runs").select("run_id", R.first_named(F.trim("providers.judgeBaseUrl"), F.trim("providers.baseUrl"), F.lit("environment")).alias("judge"))


# filters


@_query(f"SELECT s.name, c.suite, count(*) AS cases FROM systems s JOIN {CASES_SQL} c ON s.suites IS NULL OR list_contains(s.suites, c.suite) WHERE c.suite IN ('asqa', 'legalbench') GROUP BY ALL")
def flt1_suites(spark: SparkSession, d: str) -> DataFrame:
    wanted = cases(spark, d).where(F.col("suite").isin("asqa", "legalbench"))
    return grid.job_grid(table(spark, d, "systems"), wanted, 1).groupBy(F.col("system").alias("name"), "suite").agg(F.count("*").alias("cases"))


@_query(f"SELECT DISTINCT run.caseId AS case_id FROM results WHERE run.caseId NOT IN (SELECT id FROM {CASES_SQL})")
def flt2_unknown_cases(spark: SparkSession, d: str) -> DataFrame:
    return grid.unknown(table(spark, d, "results").select(F.col("run.caseId").alias("case_id")), cases(spark, d).select(F.col("id").alias("case_id")), "case_id")


@_query("SELECT name, models['main'] AS model FROM systems WHERE name IN ('direct', 'cite-v1', 'review-v1')")
def flt3_systems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "systems").where(F.col("name").isin("direct", "cite-v1", "review-v1")).select("name", F.try_element_at("models", F.lit("main")).alias("model"))


@_query(f"SELECT r.ord, s.suites IS NULL OR list_contains(s.suites, r.suite) AS listed FROM {GRADED_SQL} r JOIN systems s ON s.name = r.system")
def flt4_listed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "systems").select(F.col("name").alias("system"), "suites")
    return graded(spark, d).join(s, "system").select("ord", grid.runs_suite(F.col("suites"), F.col("suite")).alias("listed"))


@_query(f"SELECT doc_id, len(regexp_split_to_array(text, '{WS}+')) AS parts FROM documents WHERE source = 'contracts' AND len(regexp_split_to_array(text, '{WS}+')) BETWEEN 100 AND 400")
def flt5_length_window(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").where("source = 'contracts'").where(D.in_length_window("text", 100, 400))
    return c.select("doc_id", X.split_count("text").cast("bigint").alias("parts"))


@_query("SELECT doc_id FROM documents WHERE source = 'contracts' AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'contracts' ORDER BY length(text), doc_id LIMIT 2)")
def flt6_without_demos(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").where("source = 'contracts'")
    demos = c.orderBy(F.length("text"), "doc_id").limit(2)
    return c.join(demos.select("doc_id"), "doc_id", "left_anti").select("doc_id")


@_query(f"SELECT p.id, len(p.clauses) > 0 AS present FROM private_cases p JOIN {CASES_SQL} c USING (id) WHERE p.clauses IS NOT NULL AND c.suite = 'cuad'")
def flt7_servable(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).where("clauses is not null").join(cases(spark, d).where("suite = 'cuad'").select("id"), "id").select("id", (F.size("clauses") > 0).alias("present"))


@_query(f"SELECT id, suite FROM (SELECT p.id, c.suite, len(p.clauses) AS n, max(CASE WHEN len(p.clauses) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY c.suite) AS multi FROM private_cases p JOIN {CASES_SQL} c USING (id) WHERE p.clauses IS NOT NULL) WHERE multi = 0 OR n > 1")
def flt8_prefer_multi(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).where("clauses is not null").join(cases(spark, d).select("id", "suite"), "id")
    several = F.size("clauses") > 1
    return g.withColumn("multi", F.max(several).over(Window.partitionBy("suite"))).where(~F.col("multi") | several).select("id", "suite")


@_query(f"SELECT id FROM {CASES_SQL} WHERE id NOT IN (SELECT id FROM private_cases)")
def flt9_missing(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("id").join(gold(spark, d).select("id"), "id", "left_anti")


@_query("""SELECT ord, loaded_at, CASE WHEN s.name IS NULL THEN 401 WHEN len(list_intersect(run.models, map_values(s.models))) < len(list_distinct(run.models)) THEN 403 WHEN run.modelCalls > coalesce(s.maxCalls, 20) THEN 429 ELSE 200 END AS code
  FROM results r LEFT JOIN systems s ON s.name = r.run.system""")
def flt10_gate(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "systems").select(F.col("name").alias("system"), F.col("models").alias("allowed"), "maxCalls", F.lit(True).alias("known"))
    r = table(spark, d, "results").withColumn("system", F.col("run.system")).join(s, "system", "left")
    model = F.coalesce(F.size(F.array_except("run.models", F.map_values("allowed"))) <= 0, F.lit(True))
    return r.select("ord", "loaded_at", grid.gate(F.coalesce("known", F.lit(False)), F.lit(True), model, F.coalesce(F.col("run.modelCalls") <= F.coalesce("maxCalls", F.lit(20)), F.lit(True))).alias("code"))


@_query(f"SELECT ord, len(list_filter({sentences_sql('output')}, lambda s: len(string_split({uncite_sql('s')}, ' ')) >= 3)) AS n FROM {RECORDS_SQL} WHERE output IS NOT NULL")
def flt11_long_sentences(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(X.sentences("output"), lambda s: F.size(F.split(X.remove_citations(s), " ")) >= G.MIN_WORDS)
    return records(spark, d).where("output is not null").select("ord", F.size(kept).cast("bigint").alias("n"))


@_query(f"SELECT name FROM systems WHERE name IN (SELECT system FROM {GRADED_SQL} WHERE suite = 'cuad')")
def flt13_ran_suite(spark: SparkSession, d: str) -> DataFrame:
    ran = graded(spark, d).where("suite = 'cuad'").select(F.col("system").alias("name"))
    return table(spark, d, "systems").join(ran, "name", "left_semi").select("name")


@_query(f"SELECT DISTINCT g.grader FROM (SELECT unnest(grades) AS g FROM {GRADED_SQL}) WHERE g.grader IN ('exact', 'str-em', 'citation-recall', 'citation-precision', 'clause-recall', 'clause-precision', 'citation-support', 'removal', 'leakage', 'retention')")
def flt14_glossary(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(g, f.__doc__.split(".")[0]) for g, f in G.REGISTRY.items()], "grader string, description string")
    used = graded(spark, d).select(F.explode("grades.grader").alias("grader"))
    return known.join(used, "grader", "left_semi").select("grader")


# joins


@_query(f"SELECT c.id, c.suite, p.graders FROM {CASES_SQL} c JOIN private_cases p USING (id)")
def jn1_case_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("id", "suite").join(gold(spark, d).select("id", "graders"), "id")


@_query(f"SELECT s.name AS system, CAST(r.r AS INTEGER) AS repetition, c.id AS case_id, c.suite FROM systems s JOIN {CASES_SQL} c ON s.suites IS NULL OR list_contains(s.suites, c.suite), generate_series(1, 2) r(r)")
def jn2_job_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.job_grid(table(spark, d, "systems"), cases(spark, d), 2)


@_query("SELECT id, g AS grader, g IN ('exact', 'str-em', 'citation-recall', 'citation-precision', 'clause-recall', 'clause-precision', 'citation-support', 'removal', 'leakage', 'retention') AS known FROM (SELECT id, unnest(graders) AS g FROM private_cases)")
def jn4_registry(spark: SparkSession, d: str) -> DataFrame:
    known = F.broadcast(spark.createDataFrame([(g,) for g in G.REGISTRY], "grader string").withColumn("known", F.lit(True)))
    return gold(spark, d).select("id", F.explode("graders").alias("grader")).join(known, "grader", "left").select("id", "grader", F.coalesce("known", F.lit(False)).alias("known"))


_PIECES = rf"""p0 AS (SELECT doc_id, regexp_extract_all(text, '(?s)(?:.*?[.!?]+{WS}+|.+\z)') AS ps FROM documents WHERE text IS NOT NULL),
  p AS MATERIALIZED (SELECT doc_id, i, length(ps[i]) AS len, len(list_filter(regexp_split_to_array(ps[i], '{WS}+'), lambda q: q <> '')) AS words, regexp_matches(ps[i], '[.!?]{WS}+\z') AS ended, i = len(ps) AS last FROM (SELECT doc_id, ps, unnest(generate_series(1, len(ps))) AS i FROM p0)),
  w AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS pos, 0::BIGINT AS words, FALSE AS cut, 0::BIGINT AS began FROM p
    UNION ALL SELECT p.doc_id, p.i, CASE WHEN w.words + p.words >= 200 AND p.ended THEN w.pos + p.len ELSE w.start END, w.pos + p.len, CASE WHEN w.words + p.words >= 200 AND p.ended THEN 0 ELSE w.words + p.words END, w.words + p.words >= 200 AND p.ended, w.start FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
  b AS (SELECT doc_id, began AS s, pos AS e FROM w WHERE cut UNION ALL SELECT w.doc_id, w.start, w.pos FROM w JOIN p USING (doc_id, i) WHERE p.last AND w.start < w.pos),
  chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) AS INTEGER) AS part, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS parts, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end" FROM b)"""


@_query(f"WITH RECURSIVE {_PIECES} SELECT c.doc_id, part, parts, c.\"start\", c.\"end\", {collapse_sql('substring(d.text, c.\"start\" + 1, c.\"end\" - c.\"start\")')} AS passage FROM chunks c JOIN documents d USING (doc_id)")
def win2_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.chunk(table(spark, d, "documents"), "doc_id", "text")


_AT = "WITH RECURSIVE {pieces}, m AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[0-9]+'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x)) AS lens FROM documents), o AS (SELECT doc_id, gaps, lens, unnest(generate_series(1, len(lens))) AS k FROM m), s AS (SELECT doc_id, CAST(sum(gaps[k]) OVER w + coalesce(sum(lens[k]) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s, lens[k] AS l FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY k))"


@_query(_AT.format(pieces=_PIECES) + " SELECT s.doc_id, s, CAST(s + l AS INTEGER) AS e, part FROM s JOIN chunks c ON c.doc_id = s.doc_id AND c.\"start\" < s + l AND s < c.\"end\"")
def jn6_span_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Every number of every document with the chunks it lies in."""
    docs = table(spark, d, "documents")
    gaps, lens = F.transform(F.split("text", "[0-9]+", -1), lambda x: F.length(x)), F.transform(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x))
    both = docs.select("doc_id", F.arrays_zip(gaps.alias("gap"), lens.alias("len")).alias("x")).select("doc_id", F.filter("x", lambda x: x["len"].isNotNull()).alias("x"))
    # the places are running sums of gaps and lengths, in the order of the text
    running = F.aggregate("x", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")), lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("s"), (a["at"] + x["gap"] + x["len"]).alias("e"))).alias("out")))
    return D.span_overlap(both.select("doc_id", F.inline(running["out"])), D.chunk(docs, "doc_id", "text"), "doc_id")


_A = f"WITH a AS {ANSWERS_SQL}"
_CITED = f"{_A}, c AS (SELECT ord, docs, clauses, {cites_sql('output', 'len(docs)')} AS cited FROM a WHERE len(docs) > 0 AND output IS NOT NULL)"


@_query(f"{_CITED} SELECT ord, v AS passage, len(list_filter(clauses, lambda k: list_contains(k.passages, v))) > 0 AS gold FROM (SELECT ord, clauses, unnest(cited) AS v FROM c WHERE clauses IS NOT NULL)")
def jn7_cited_gold(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).where("size(docs) > 0 and output is not null and clauses is not null").withColumn("v", F.explode(X.citations("output", F.size("docs"))))
    good = F.exists("clauses", lambda k: F.coalesce(F.array_contains(k["passages"], F.col("v").cast("int")), F.lit(False)))
    return a.select("ord", F.col("v").alias("passage"), good.alias("gold"))


@_query(f"{_CITED} SELECT ord, v AS passage, docs[v + 1].title AS title FROM (SELECT ord, docs, unnest(cited) AS v FROM c)")
def jn8_cited_passages(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).where("size(docs) > 0 and output is not null").withColumn("v", F.explode(X.citations("output", F.size("docs"))))
    return a.select("ord", F.col("v").alias("passage"), F.get("docs", F.col("v").cast("int")).getField("title").alias("title"))


_QUOTES = rf"{_A}, q AS (SELECT DISTINCT ord, docs, regexp_replace(v, '^.|.$', '', 'g') AS quote FROM (SELECT ord, docs, unnest(regexp_extract_all(output, '\"[^\"]+\"')) AS v FROM a WHERE len(docs) > 0))".replace('\\"', '"')


@_query(f"{_QUOTES} SELECT ord, quote, (SELECT CAST(min(i) AS INTEGER) - 1 FROM (SELECT unnest(generate_series(1, len(docs))) AS i) WHERE contains({norm_sql('docs[i].text')}, {norm_sql('quote')})) AS passage FROM q")
def jn10_first_passage(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).where("size(docs) > 0")
    q = a.select("ord", "docs", F.explode(F.array_distinct(F.regexp_extract_all("output", F.lit('"([^"]+)"'), F.lit(1)))).alias("quote"))
    hit = F.filter(F.transform("docs", lambda x, i: F.when(X.contains_normalized(x["text"], F.col("quote")), i)), lambda i: i.isNotNull())
    return q.select("ord", "quote", F.get(hit, 0).alias("passage"))


@_query(f"{_QUOTES} SELECT ord, quote, CAST(i - 1 AS INTEGER) AS passage FROM (SELECT ord, quote, docs, unnest(generate_series(1, len(docs))) AS i FROM q) WHERE contains({norm_sql('docs[i].text')}, {norm_sql('quote')})")
def jn9_quote_passages(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).where("size(docs) > 0")
    q = a.select("ord", "docs", F.explode(F.array_distinct(F.regexp_extract_all("output", F.lit('"([^"]+)"'), F.lit(1)))).alias("quote"))
    flat = q.select("ord", "quote", F.posexplode("docs").alias("passage", "doc"))
    return flat.where(X.contains_normalized("doc.text", "quote")).select("ord", "quote", "passage")


@_query(f"SELECT ord, r.case_id FROM {RECORDS_SQL} r WHERE NOT EXISTS (SELECT 1 FROM {CASES_SQL} c WHERE c.id = r.case_id)")
def jn14_regrade_missing(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("ord", "case_id").join(cases(spark, d).select(F.col("id").alias("case_id")), "case_id", "left_anti").select("ord", "case_id")


@_query("SELECT name, coalesce(providers[models['main']].baseUrl, 'http://default.invalid/v1') AS upstream FROM systems")
def jn15_upstream(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "systems").select("name", grid.upstream(F.col("models"), F.col("providers"), "main", "http://default.invalid/v1").alias("upstream"))


_SAID = f"""{_A}, s AS (SELECT case_id, len(docs) AS n, unnest({sentences_sql("coalesce(output, '')")}) AS sentence FROM a WHERE len(docs) > 0 AND (error IS NULL OR error = '') AND (list_contains(graders, 'citation-recall') OR list_contains(graders, 'citation-precision'))),
  q AS (SELECT DISTINCT case_id, {uncite_sql('sentence')} AS claim, {cites_sql('sentence', 'n')} AS refs FROM s)"""


@_query(f"{_SAID} SELECT count(*) AS asked FROM q WHERE len(refs) > 0")
def jn16_distinct_questions(spark: SparkSession, d: str) -> DataFrame:
    """How many questions recall and then precision put about whole sentences: each once, whichever asks."""
    a = answers(spark, d).where("error is null or error = ''")
    memo = Memo(passages=cases(spark, d).select(F.col("id").alias("case_id"), "docs"))
    both = a.where(F.arrays_overlap("graders", F.array(F.lit("citation-recall"), F.lit("citation-precision"))))
    memo.sentences = cut_lineage(G.cited_sentences(both).drop("sentence"))
    for name in ("citation-recall", "citation-precision"):
        asked = G.entailed(memo.sentences.where(F.array_contains("graders", name) & (F.size("refs") > 0)), F.col("refs"))
        memo.rule(asked, ["ord", "s"])
    return memo.verdicts.agg(F.count("*").alias("asked"))


@_query(f"SELECT DISTINCT c.suite AS benchmark, g AS grader, g IN ({', '.join(repr(x) for x in G.REGISTRY)}) AS known, count(DISTINCT c.suite) OVER (PARTITION BY g) > 1 AS clash FROM (SELECT DISTINCT id, unnest(graders) AS g FROM private_cases) p JOIN {CASES_SQL} c USING (id)".replace("count(DISTINCT c.suite) OVER (PARTITION BY g) > 1", "(SELECT count(DISTINCT c2.suite) FROM private_cases p2 JOIN public_cases c2 USING (id) WHERE list_contains(p2.graders, g)) > 1"))
def jn18_clashes(spark: SparkSession, d: str) -> DataFrame:
    """Each suite's graders, whether they are registered, and which come from several suites' modules."""
    listed = gold(spark, d).select("id", F.explode("graders").alias("g")).join(cases(spark, d).select("id", "suite"), "id")
    per = listed.groupBy("suite").agg(F.collect_set("g").alias("graders")).select(F.col("suite").alias("name"), "graders", F.concat(F.lit("benchmarks/"), "suite").alias("module"))
    return R.resolve_graders(per, G.REGISTRY)


@_query(f"SELECT s.name AS system, 3 * count(*) AS jobs FROM systems s JOIN {CASES_SQL} c ON s.suites IS NULL OR list_contains(s.suites, c.suite) GROUP BY ALL")
def agg17_expected_jobs(spark: SparkSession, d: str) -> DataFrame:
    return grid.job_grid(table(spark, d, "systems"), cases(spark, d), 3).groupBy("system").agg(F.count("*").alias("jobs"))


# windows


@_query(f"""WITH r AS (SELECT c.task, p.answer, p.id FROM private_cases p JOIN {CASES_SQL} c USING (id) WHERE p.answer IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY task, answer ORDER BY id) AS k, min(id) OVER (PARTITION BY task, answer) AS f FROM r)
  SELECT task, answer, id, CAST(row_number() OVER (PARTITION BY task ORDER BY k, f, id) AS INTEGER) AS pick FROM n QUALIFY pick <= 20""")
def win1_round_robin(spark: SparkSession, d: str) -> DataFrame:
    r = gold(spark, d).where("answer is not null").select("id", "answer").join(cases(spark, d).select("id", "task"), "id")
    return D.round_robin(r, "task", "answer", "id", 20).select("task", "answer", "id", "pick")


def _contracts(spark: SparkSession, d: str) -> DataFrame:
    """Contracts of the clause cases: which clause types they were asked for and how many instances they have."""
    named = F.regexp_extract("input", r'contract ["“«„]?\s?([A-Z_ ]+)', 1)
    c = cases(spark, d).where(F.col("suite").isin("cuad", "cuad-hard")).select("id", named.alias("contract"), F.regexp_extract("input", '["“«„]\\s?([A-Z][a-z]+(?: [A-Za-z]+)*)\\s?["”»“]', 1).alias("category"))
    g = gold(spark, d).where("clauses is not null").select("id", F.size("clauses").alias("n"))
    return c.join(g, "id").where("contract != '' and category != ''").groupBy("contract", "category").agg(F.max("n").alias("n_answers")).groupBy("contract").agg(F.array_sort(F.collect_list(F.struct("category", "n_answers"))).alias("qas"))


# fixed values: the clause types of the test tables
TYPES = ("Audit Access", "Cap on Damages", "Choice of Law", "Escrow Release", "Exclusive Area", "Exit Notice", "Insurance Floor", "License Term", "Price Parity", "Renewal Window", "Rival Work Ban", "Transfer Ban")


#: The contracts of the clause cases, in the order of their names, with the types they were asked for.
_CONTRACTS = rf"""qs AS (SELECT regexp_extract(c.input, 'contract ["“«„]?\s?([A-Z_ ]+)', 1) AS contract, regexp_extract(c.input, '["“«„]\s?([A-Z][a-z]+(?: [A-Za-z]+)*)\s?["”»“]', 1) AS category, max(len(p.clauses)) AS n
    FROM {CASES_SQL} c JOIN private_cases p USING (id) WHERE p.clauses IS NOT NULL AND c.suite IN ('cuad', 'cuad-hard') AND regexp_extract(c.input, 'contract ["“«„]?\s?([A-Z_ ]+)', 1) <> '' AND regexp_extract(c.input, '["“«„]\s?([A-Z][a-z]+(?: [A-Za-z]+)*)\s?["”»“]', 1) <> '' GROUP BY ALL),
  k AS (SELECT contract, list(struct_pack(category := category, n := n)) AS qas, row_number() OVER (ORDER BY contract) - 1 AS nth FROM qs GROUP BY contract)"""
_LOW = 4294967296
_MUL = "CAST(CAST({a} AS HUGEINT) * {b} % 4294967296 AS BIGINT)"
#: The generator's k-th draw, then the shuffle's steps: written from the definition, without the functions under test.
_SHUFFLED = f"""d0 AS (SELECT k, CAST(({SHUFFLE_SEED} + CAST(k AS HUGEINT) * 1831565813) % {_LOW} AS BIGINT) AS s FROM generate_series(1, (SELECT count(*) FROM k)) g(k)),
  d1 AS (SELECT k, {_MUL.format(a='xor(s, s >> 15)', b='(s | 1)')} AS x FROM d0),
  d2 AS (SELECT k, xor(x, (x + {_MUL.format(a='xor(x, x >> 7)', b='(x | 61)')}) % {_LOW}) AS x FROM d1),
  draws AS (SELECT k, CAST(xor(x, x >> 14) AS DOUBLE) / {_LOW} AS u FROM d2),
  f AS (SELECT (SELECT count(*) FROM k) - 1 AS last, 1 AS step, range(0, (SELECT count(*) FROM k)) AS o
    UNION ALL SELECT last - 1, step + 1, list_transform(o, lambda v, i: CASE WHEN i = last + 1 THEN o[CAST(floor(u * (last + 1)) AS BIGINT) + 1] WHEN i = CAST(floor(u * (last + 1)) AS BIGINT) + 1 THEN o[last + 1] ELSE v END) FROM f JOIN draws ON draws.k = f.step WHERE last > 0),
  placed AS (SELECT contract, qas, p - 1 AS place FROM (SELECT unnest(o) AS nth, unnest(range(1, len(o) + 1)) AS p FROM f WHERE last <= 0 OR (SELECT count(*) FROM k) = 0) JOIN k USING (nth))"""
_TYPES = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_FIT = f"list_filter(range(1, {len(TYPES)} + 1), lambda t: len(list_filter(p.qas, lambda q: q.category = {_TYPES}[t] AND (q.n = 0) = (b.made % 10 IN (2, 5, 8)))) > 0)"
_BALANCED = f"""b AS (SELECT -1::BIGINT AS place, 0 AS made, list_transform(range(0, {len(TYPES)}), lambda t: 0) AS used, NULL::VARCHAR AS contract, NULL::BIGINT AS pick, FALSE AS absent
    UNION ALL SELECT place, made + CASE WHEN pick IS NULL THEN 0 ELSE 1 END, list_transform(used, lambda u, i: CASE WHEN i = pick THEN u + 1 ELSE u END), contract, pick, absent
    FROM (SELECT p.place, b.made, b.used, p.contract, b.made % 10 IN (2, 5, 8) AS absent, list_sort(list_transform({_FIT}, lambda t: struct_pack(u := b.used[t], t := t)))[1].t AS pick FROM b JOIN placed p ON p.place = b.place + 1)),
  chosen AS (SELECT CAST(made - 1 AS INTEGER) AS i, contract, {_TYPES}[pick] AS category, absent FROM b WHERE pick IS NOT NULL)"""


@_query(f"WITH RECURSIVE {_CONTRACTS}, {_SHUFFLED}, {_BALANCED} SELECT * FROM chosen")
def win5_greedy_balance(spark: SparkSession, d: str) -> DataFrame:
    placed = D.seeded_order(_contracts(spark, d), "contract", ["contract"])
    return D.greedy_balance(placed, TYPES)


@_query(f"WITH RECURSIVE {_CONTRACTS}, {_SHUFFLED}, {_BALANCED} SELECT * FROM chosen WHERE i >= 5")
def win6_skipped(spark: SparkSession, d: str) -> DataFrame:
    """A set that goes on after its first five."""
    return D.greedy_balance(D.seeded_order(_contracts(spark, d), "contract", ["contract"]), TYPES, skip=5)


@_query(f"WITH RECURSIVE {_CONTRACTS}, {_SHUFFLED} SELECT contract, CAST(place AS INTEGER) AS place, place % 10 IN (2, 5, 8) AS absent FROM placed")
def win4_absent(spark: SparkSession, d: str) -> DataFrame:
    """Which of the shuffled contracts fall on the places of absence."""
    return D.seeded_order(_contracts(spark, d), "contract", ["contract"]).select("contract", "place", (F.col("place") % 10).isin(*D.ABSENT_AT).alias("absent"))


@_query(f"SELECT ord, run_id, CAST(row_number() OVER w AS INTEGER) AS call, row_number() OVER w <= 20 AS allowed FROM {RECORDS_SQL} WINDOW w AS (PARTITION BY run_id ORDER BY ord)")
def win8_call_limit(spark: SparkSession, d: str) -> DataFrame:
    return grid.over_limit(records(spark, d).select("ord", "run_id"), "run_id", "ord", F.lit(20))


@_query(f"""WITH j AS (SELECT s.name AS system, r.r AS repetition, c.id AS case_id FROM systems s JOIN {CASES_SQL} c ON s.suites IS NULL OR list_contains(s.suites, c.suite), generate_series(1, 2) r(r))
  SELECT system, CAST(repetition AS INTEGER) AS repetition, case_id, CAST(dense_rank() OVER (ORDER BY system) AS INTEGER) AS system_ord, CAST(dense_rank() OVER (PARTITION BY system ORDER BY case_id) AS INTEGER) AS case_ord FROM j""")
def win9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return grid.canonical_order(grid.job_grid(table(spark, d, "systems"), cases(spark, d), 2)).select("system", "repetition", "case_id", "system_ord", "case_ord")


@_query(f"SELECT id, CAST(k // 5 AS INTEGER) AS batch, list(CAST(k AS INTEGER) ORDER BY k) AS places FROM (SELECT id, unnest(generate_series(0, len(docs) - 1)) AS k FROM {CASES_SQL} WHERE len(docs) > 0) GROUP BY ALL")
def win10_batches(spark: SparkSession, d: str) -> DataFrame:
    return S.scan_batches(cases(spark, d), S.SCAN_BATCH)


# sorts and limits


@_query("SELECT doc_id, length(text) AS n FROM documents WHERE source = 'contracts' ORDER BY length(text), doc_id LIMIT 1")
def srt3_shortest(spark: SparkSession, d: str) -> DataFrame:
    """The shortest contract: the operator gives one."""
    return D.shortest_first(table(spark, d, "documents"), "doc_id", "text", F.col("source") == "contracts").select("doc_id", F.length("text").cast("bigint").alias("n"))


@_query(f"SELECT ord, list_sort(list_transform(grades, lambda g: g.grader)) AS graders FROM {RECORDS_SQL}")
def srt5_sorted_grades(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("ord", F.array_sort("grades.grader").alias("graders"))


@_query(f"WITH RECURSIVE {_CONTRACTS}, {_SHUFFLED} SELECT contract, CAST(place AS INTEGER) AS place FROM placed")
def srt7_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return D.seeded_order(_contracts(spark, d).select("contract"), "contract", ["contract"])


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Contracts with their places from 0."""
    return D.seeded_order(_contracts(spark, d).select("contract"), "contract", ["contract"])


@_query(f"WITH RECURSIVE {_CONTRACTS}, {_SHUFFLED} SELECT contract, CAST(place AS INTEGER) AS place FROM placed WHERE place >= 30 AND place < 50")
def lim1_offset(spark: SparkSession, d: str) -> DataFrame:
    """Twenty contracts after the first thirty of a shuffled set."""
    return D.page(_placed(spark, d), "place", 30, 20)


@_query(f"WITH RECURSIVE {_CONTRACTS}, {_SHUFFLED} SELECT contract, CAST(place AS INTEGER) AS place FROM placed WHERE place < 5")
def lim3_exactly(spark: SparkSession, d: str) -> DataFrame:
    """Exactly five contracts, or an error."""
    return D.exactly(_placed(spark, d), "place", 5)


# sets


@_query("SELECT kind, count(*) AS n FROM (SELECT 'case' AS kind, id FROM public_cases UNION ALL SELECT 'gold', id FROM private_cases) GROUP BY ALL")
def set1_union(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "public_cases").select(F.lit("case").alias("kind"), "id").unionByName(gold(spark, d).select(F.lit("gold").alias("kind"), "id"))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


@_query("SELECT DISTINCT unnest(graders) AS grader FROM private_cases")
def set2_distinct_graders(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).select(F.explode("graders").alias("grader")).distinct()


@_query("SELECT id FROM public_cases EXCEPT SELECT id FROM private_cases")
def set4_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "public_cases").select("id").subtract(gold(spark, d).select("id"))


@_query("SELECT lang FROM (SELECT lang FROM documents WHERE source = 'forum') INTERSECT ALL SELECT lang FROM documents WHERE source = 'notes'")
def set5_bag_intersection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where("source = 'forum'").select("lang").intersectAll(docs.where("source = 'notes'").select("lang"))


@_query("SELECT name, list_sort(list_intersect(suites, ['asqa', 'cuad', 'legalbench'])) AS shared FROM systems")
def set6_shared_suites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "systems").select("name", F.array_sort(F.array_intersect("suites", F.array(*map(F.lit, ("asqa", "cuad", "legalbench"))))).alias("shared"))


@_query(f"{_CITED} SELECT ord, v AS passage, list_filter(cited, lambda o: o <> v) AS others FROM (SELECT ord, cited, unnest(cited) AS v FROM c WHERE len(cited) > 1)")
def set7_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).where("size(docs) > 0 and output is not null").withColumn("cited", X.citations("output", F.size("docs"))).where("size(cited) > 1")
    return a.withColumn("passage", F.explode("cited")).select("ord", "passage", F.array_remove("cited", F.col("passage")).alias("others"))


@_query("WITH RECURSIVE s AS (SELECT 1 AS k, (20260830::BIGINT * 1664525 + 1013904223) % 4294967296 AS state UNION ALL SELECT k + 1, (state * 1664525 + 1013904223) % 4294967296 FROM s WHERE k < 500) SELECT k, state FROM s")
def mth1_generator(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i + 1, int(s)) for i, s in enumerate(lcg_states(500))], "k int, state bigint")


# systems: the scripted model answers from the prompts


def _system(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        r = S.SYSTEMS[name](cases(spark, d))
        return r.select("id", "system", "output", "error", "model_calls", "findings", "decision")

    return query


QUERIES |= {f"sys{i}_{n.replace('-', '_')}": _system(n) for i, n in enumerate(S.SYSTEMS, 1)}


_BODY = """CASE WHEN choices IS NOT NULL THEN instructions || chr(10) || chr(10) || {x} || chr(10) || chr(10) || coalesce(question, '') || chr(10) || 'One of: ' || array_to_string(choices, ', ')
    WHEN suite = 'redaction' THEN {x} ELSE instructions || array_to_string(list_transform(coalesce(examples, []), lambda e: chr(10) || chr(10) || e.q || chr(10) || 'Answer: ' || e.a), '') || chr(10) || chr(10) || {x} END"""
#: What the scripted model answers to the three kinds of prompts, from their bodies.
_HEADS = r"regexp_extract_all(body, 'Document \[(\d+)\]\(Title: [^\n]*?\): ([^.!?\n]*[.!?])', {g})"
_REPLY = f"""CASE WHEN choices IS NOT NULL THEN choices[length(body) % len(choices) + 1] WHEN suite = 'redaction' THEN {strip_sql('body')}
    WHEN len({_HEADS.format(g=1)}) > 0 THEN array_to_string(list_transform(range(1, least(3, len({_HEADS.format(g=1)})) + 1), lambda i: rtrim({_HEADS.format(g=2)}[i], '.!?') || ' [' || {_HEADS.format(g=1)}[i] || '].'), ' ')
    ELSE {strip_sql(f"left(string_split({strip_sql('body')}, chr(10))[-1], 200)")} END"""
_RAN = "id, '{name}' AS system, {out} AS output, NULL::VARCHAR AS error, 1 AS model_calls, {found} AS findings, CASE WHEN len({found}) > 0 OR {out} <> reply THEN 'modified' ELSE 'pass' END AS decision"
_NO_FINDINGS = "CAST([] AS VARCHAR[])"
ORACLE["sys1_direct"] = f"SELECT {_RAN.format(name='direct', out='reply', found=_NO_FINDINGS)} FROM (SELECT *, {_REPLY} AS reply FROM (SELECT *, {_BODY.format(x='input')} AS body FROM {CASES_SQL}))"
_SCRUBBED = "CASE WHEN suite = 'redaction' THEN {f} ELSE {e} END"
ORACLE["sys2_placeholder"] = f"""SELECT {_RAN.format(name='placeholder', out=_SCRUBBED.format(f=scrub_sql('reply'), e='reply'), found=_SCRUBBED.format(f=f"({findings_sql('input')}) || ({findings_sql('reply')})", e=_NO_FINDINGS))}
  FROM (SELECT *, {_REPLY} AS reply FROM (SELECT *, {_BODY.format(x=_SCRUBBED.format(f=scrub_sql('input'), e='input'))} AS body FROM {CASES_SQL}))"""


_NAMES = "list_filter(regexp_extract_all({x}, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b'), lambda v, i: list_position(regexp_extract_all({x}, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b'), v) = i)"


def _wiped(items: str, x: str) -> str:
    return f"list_reduce({items}, lambda acc, v: regexp_replace(acc, '(?i)' || {flexible_sql('v')}, '[REDACTED]', 'g'), {x})"


#: Patterns, then the names that the scripted model lists, before the call and after it.
ORACLE["sys3_legal_v1"] = f"""WITH c AS (SELECT *, {scrub_sql('input')} AS s1 FROM {CASES_SQL}), n AS (SELECT *, {_NAMES.format(x="('List the personal data.' || chr(10) || s1)")} AS i1 FROM c),
    r AS (SELECT *, {_REPLY} AS reply FROM (SELECT *, CASE WHEN suite = 'redaction' THEN {_wiped('i1', 's1')} ELSE {_BODY.format(x='input')} END AS body FROM n)),
    t AS (SELECT *, {_NAMES.format(x="('List the personal data.' || chr(10) || s2)")} AS i2 FROM (SELECT *, {scrub_sql('reply')} AS s2 FROM r)),
    o AS (SELECT id, suite, reply, CASE WHEN suite = 'redaction' THEN {_wiped('i2', 's2')} ELSE reply END AS output,
      CASE WHEN suite = 'redaction' THEN ({findings_sql('input')}) || list_transform(i1, lambda v: 'llm:' || v) || ({findings_sql('reply')}) || list_transform(i2, lambda v: 'llm:' || v) ELSE {_NO_FINDINGS} END AS findings FROM t)
  SELECT id, 'legal-v1' AS system, output, NULL::VARCHAR AS error, CASE WHEN suite = 'redaction' THEN 3 ELSE 1 END AS model_calls, findings, CASE WHEN len(findings) > 0 OR output <> reply THEN 'modified' ELSE 'pass' END AS decision FROM o"""


_LONG_WORDS = "list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{4,}}'))"
_MARKED = "array_to_string(list_transform({x}, lambda v: '[' || (v + 1) || ']'), '')"
_DRAFT = f"CASE WHEN len({_HEADS.format(g=1)}) > 0 THEN array_to_string(list_transform(range(1, least(3, len({_HEADS.format(g=1)})) + 1), lambda i: rtrim({_HEADS.format(g=2)}[i], '.!?') || ' [' || {_HEADS.format(g=1)}[i] || '].'), ' ') ELSE {strip_sql(f"left(string_split({strip_sql('body')}, chr(10))[-1], 200)")} END"
#: A draft, and for each of its sentences the passages whose first lines have half of its long words.
ORACLE["sys4_cite_v1"] = rf"""WITH d AS (SELECT id, coalesce(docs, []) AS docs, {_DRAFT} AS reply FROM (SELECT *, instructions || array_to_string(list_transform(coalesce(examples, []), lambda e: chr(10) || chr(10) || e.q || chr(10) || 'Answer: ' || e.a), '') || chr(10) || chr(10) || input AS body FROM {CASES_SQL})),
    u AS (SELECT id, docs, ss[k] AS sent, k FROM (SELECT id, docs, ss, unnest(generate_series(1, len(ss))) AS k FROM (SELECT id, docs, {sentences_sql('reply')} AS ss FROM d))),
    c AS (SELECT *, {uncite_sql('sent')} AS claim FROM u),
    v AS (SELECT *, {_LONG_WORDS.format(x='claim')} AS long FROM c),
    h AS (SELECT *, list_filter(range(0, len(docs)), lambda i: len(long) > 0 AND 2 * len(list_intersect(long, {_LONG_WORDS.format(x="string_split(coalesce(docs[i + 1].text, ''), chr(10))[1]")})) >= len(long))[1:2] AS refs, {cites_sql('sent', 'len(docs)')} AS before FROM v),
    t AS (SELECT *, len(refs) = 0 AND contains(' ' || claim || ' ', ' no ') AS keep FROM h),
    f AS (SELECT id, k, CASE WHEN keep THEN claim WHEN len(refs) > 0 THEN regexp_extract(claim, '(?s)^(.*?)([.!?]*)\z', 1) || ' ' || {_MARKED.format(x='refs')} || regexp_extract(claim, '(?s)^(.*?)([.!?]*)\z', 2) END AS text,
      's' || k || ': ' || CASE WHEN keep THEN 'stays uncited, it speaks of the documents' WHEN len(refs) = 0 THEN 'removed, nothing supports it'
        ELSE CASE WHEN len(before) > 0 THEN {_MARKED.format(x='before')} ELSE 'none' END || ' => ' || {_MARKED.format(x='refs')} || CASE WHEN len(refs) = len(before) AND len(list_intersect(refs, before)) = len(refs) THEN '' ELSE ', new' END END AS finding FROM t),
    g AS (SELECT id, coalesce(string_agg(text, ' ' ORDER BY k), '') AS output, list(finding ORDER BY k) AS findings, count(*) AS n FROM f GROUP BY id)
  SELECT d.id, 'cite-v1' AS system, coalesce(output, '') AS output, NULL::VARCHAR AS error, CAST(1 + coalesce(n, 0) AS INTEGER) AS model_calls, coalesce(findings, {_NO_FINDINGS}) AS findings, CASE WHEN coalesce(n, 0) > 0 OR coalesce(output, '') <> reply THEN 'modified' ELSE 'pass' END AS decision FROM d LEFT JOIN g USING (id)"""


@_query(f"""WITH j AS (SELECT s.name AS system, s.models['main'] AS model, c.id AS case_id, c.suite FROM systems s JOIN {CASES_SQL} c ON s.suites IS NULL OR list_contains(s.suites, c.suite) WHERE s.name LIKE 'direct%')
  SELECT system, j.case_id, 1 AS repetition, 1 AS model_calls, [model] AS models, p.id IS NOT NULL AS has_gold, CAST(coalesce(len(p.graders), 0) AS INTEGER) AS grades, CAST(0 AS BIGINT) AS judge_calls FROM j LEFT JOIN private_cases p ON p.id = j.case_id""")
def sys8_records(spark: SparkSession, d: str) -> DataFrame:
    """A run of all one-prompt systems over all their cases, graded: what each record took and holds."""
    names = [r.name for r in table(spark, d, "systems").where("name like 'direct%'").select("name").collect()]  # settings
    made = cut_lineage(R.run_records(table(spark, d, "systems"), cases(spark, d), names=names))
    out = R.graded_records(made, cases(spark, d), gold(spark, d))
    known = gold(spark, d).select(F.col("id").alias("case_id"), F.lit(True).alias("has_gold"))
    flat = out.select("run.system", F.col("run.caseId").alias("case_id"), "run.repetition", F.col("run.modelCalls").alias("model_calls"), "run.models", F.size("grades").alias("grades"), F.col("judge.modelCalls").alias("judge_calls"))
    return flat.join(known, "case_id", "left").withColumn("has_gold", F.coalesce("has_gold", F.lit(False)))


@_query(f"""SELECT r.ord, r.case_id, c.id IS NULL AS missing, CASE WHEN c.id IS NULL THEN NULL WHEN p.id IS NULL THEN 0 ELSE coalesce(len(p.graders), 0) END AS grades, CASE WHEN c.id IS NULL THEN NULL WHEN r.error IS NOT NULL AND r.error <> '' THEN TRUE ELSE FALSE END AS failed
  FROM {RECORDS_SQL} r LEFT JOIN {CASES_SQL} c ON c.id = r.case_id LEFT JOIN private_cases p ON p.id = r.case_id""")
def sys9_regrade(spark: SparkSession, d: str) -> DataFrame:
    """All stored records by today's graders: how many grades each got, and the records whose case is gone."""
    none = F.lit(None)
    r = records(spark, d).withColumn("findings", none.cast("array<string>")).withColumn("decision", none.cast("string")).withColumn("trace", none.cast("struct<source:string,transformed_source:string,raw_output:string,released_output:string>"))
    graded_, missing = R.regrade(r, cases(spark, d), gold(spark, d))
    made = graded_.select("ord", F.col("run.caseId").alias("case_id"), F.lit(False).alias("missing"), F.size("grades").cast("bigint").alias("grades"), (F.col("status") == "run_error").alias("failed"))
    return made.unionByName(missing.select("ord", "case_id", F.lit(True).alias("missing"), none.cast("bigint").alias("grades"), none.cast("boolean").alias("failed")))
