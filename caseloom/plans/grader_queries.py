"""Graders as queries over all stored answers, each beside its SQL. The judge is the lexical stand-in."""

from __future__ import annotations

from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graders as G
from ..operators.judge import Memo
from .session import cut_lineage
from .text_queries import CHOICE_SQL, answer_sql, cites_sql, label_sql, norm_sql, run_sql, sentences_sql, span_sql, tokens_sql, uncite_sql
from .views import ANSWERS_SQL, CASES_SQL, answers, cases, gold

_A = f"WITH a AS {ANSWERS_SQL}"
_ROUND = "round(score, 6) AS score"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _memo(spark: SparkSession, d: str) -> Memo:
    """The lexical judge's memo with the passages of all cases."""
    return Memo(passages=cases(spark, d).select(F.col("id").alias("case_id"), "docs"))


def _grader(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        grade = G.REGISTRY[name]
        made = grade(answers(spark, d), _memo(spark, d)) if "judge" in signature(grade).parameters else grade(answers(spark, d))
        return _rounded(made.select("ord", "pass", "score", "detail"))

    return query


QUERIES = {f"grd{i}_{name.replace('-', '_')}": _grader(name) for i, name in enumerate(("exact", "str-em", "citation-recall", "citation-precision", "clause-recall", "clause-precision", "citation-support", "removal", "leakage", "retention"), 1)}


def grd12_gold_problems(spark: SparkSession, d: str) -> DataFrame:
    return G.gold_problems(gold(spark, d), public=cases(spark, d))


def grd13_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Regrade: every stored answer by the graders that its case lists today."""
    return _rounded(G.dispatch(cut_lineage(answers(spark, d)), judge=_memo(spark, d)).select("ord", "place", "grader", "pass", "score", "status"))


QUERIES |= {"grd12_gold_problems": grd12_gold_problems, "grd13_dispatch": grd13_dispatch}

_O = "coalesce(output, '')"
_EXACT = f"SELECT ord, x = g AS pass, CASE WHEN x = g THEN 1.0::DOUBLE ELSE 0.0 END AS score, 'extracted=' || x || ' gold=' || g AS detail FROM (SELECT ord, coalesce({CHOICE_SQL.replace('output', _O)}, '(none)') AS x, {label_sql('answer')} AS g FROM a WHERE list_contains(graders, 'exact') AND choices IS NOT NULL AND answer IS NOT NULL)"
_MISSING = f"list_filter(qaPairs, lambda p: NOT coalesce(len(list_filter(p.shortAnswers, lambda s: contains({answer_sql(_O)}, {answer_sql('s')}))) > 0, FALSE))"
_STR_EM = f"""SELECT ord, len(m) = 0 AS pass, CAST(n - len(m) AS DOUBLE) / n AS score, (n - len(m)) || '/' || n || ' sub-questions answered' || CASE WHEN len(m) > 0 THEN '; missing: ' || array_to_string(list_transform(m, lambda p: coalesce(p.shortAnswers[1], '')), ' | ') ELSE '' END AS detail
  FROM (SELECT ord, len(qaPairs) AS n, {_MISSING} AS m FROM a WHERE list_contains(graders, 'str-em') AND len(qaPairs) > 0)"""
_MARKS = "array_to_string(list_transform({x}, lambda v: '[' || (v + 1) || ']'), '')"
_CITED = f"SELECT *, {cites_sql(_O, 'len(docs)')} AS cited FROM a WHERE len(docs) > 0 AND clauses IS NOT NULL AND list_contains(graders, '{{name}}')"
_CLAUSE_PRECISION = f"""SELECT ord, CASE WHEN len(clauses) = 0 THEN len(cited) = 0 ELSE len(cited) > 0 AND r = len(cited) END AS pass,
    CASE WHEN len(clauses) = 0 THEN CASE WHEN len(cited) = 0 THEN 1.0::DOUBLE ELSE 0.0 END WHEN len(cited) = 0 THEN 0.0 ELSE CAST(r AS DOUBLE) / len(cited) END AS score,
    CASE WHEN len(cited) = 0 THEN 'nothing cited' WHEN len(clauses) = 0 THEN 'cited ' || {_MARKS.format(x='cited')} || ' for an absent clause' ELSE r || '/' || len(cited) || ' citations contain the clause' END AS detail
  FROM (SELECT ord, clauses, cited, len(list_filter(cited, lambda c: len(list_filter(clauses, lambda k: list_contains(k.passages, c))) > 0)) AS r FROM ({_CITED.format(name='clause-precision')}))"""
_DENIAL = "(regexp_matches({t}, ' (no|not|none|nothing|neither|without|absent) ') AND regexp_matches({t}, ' (clauses?|contract|documents?|passages?) '))"


def _denies(x: str) -> str:
    return _DENIAL.format(t=f"(' ' || {norm_sql(x)} || ' ')")


def _entails(premise: str, claim: str) -> str:
    words = f"list_distinct({tokens_sql(claim)})"
    return f"(CAST(len(list_intersect({words}, {tokens_sql(premise)})) AS DOUBLE) / greatest(len({words}), 1) >= 0.6)"


def _premise(refs: str) -> str:
    return f"array_to_string(list_transform({refs}, lambda v: 'Title: ' || coalesce(docs[v + 1].title, '') || chr(10) || coalesce(docs[v + 1].text, '')), chr(10))"


_CLAUSE_RECALL = f"""SELECT ord, CASE WHEN len(clauses) = 0 THEN y ELSE f = len(clauses) END AS pass, CASE WHEN len(clauses) = 0 THEN CASE WHEN y THEN 1.0::DOUBLE ELSE 0.0 END ELSE CAST(f AS DOUBLE) / len(clauses) END AS score,
    CASE WHEN len(clauses) = 0 THEN CASE WHEN y THEN 'absence stated' ELSE 'absence not stated' END ELSE f || '/' || len(clauses) || ' clauses quoted and cited (' || len(q) || ' quoted); cited ' || CASE WHEN len(cited) > 0 THEN {_MARKS.format(x='cited')} ELSE 'nothing' END
      || ', gold ' || array_to_string(list_transform(clauses, lambda c: {_MARKS.format(x='c.passages')}), ' ') END AS detail
  FROM (SELECT *, len(list_filter(q, lambda c: len(list_filter(c.passages, lambda p: list_contains(cited, p))) > 0)) AS f FROM (
    SELECT *, {_denies('coalesce(output, chr(32))')} AS y, list_filter(clauses, lambda c: {run_sql(norm_sql('c.text'), norm_sql(_O))} >= 8) AS q FROM ({_CITED.format(name='clause-recall')})))"""


def _sentences(name: str) -> str:
    return f"""l AS (SELECT * FROM a WHERE list_contains(graders, '{name}') AND len(docs) > 0),
      s0 AS (SELECT ord, docs, unnest(generate_series(1, len(ss))) AS s, ss FROM (SELECT ord, docs, {sentences_sql(_O)} AS ss FROM l)),
      s AS (SELECT ord, docs, s, {uncite_sql('ss[s]')} AS claim, {cites_sql('ss[s]', 'len(docs)')} AS refs FROM s0)"""


_CITATION_RECALL = f"""{_A}, {_sentences('citation-recall')}, e AS (SELECT ord, count(*) AS n, count_if(len(refs) > 0 AND {_entails(_premise('refs'), 'claim')}) AS ok, count_if(len(refs) = 0) AS un FROM s GROUP BY ord)
  SELECT l.ord, coalesce(n > 0 AND ok = n, FALSE) AS pass, round(coalesce(CAST(ok AS DOUBLE) / n, 0.0), 6) AS score, CASE WHEN n IS NULL THEN 'no sentences' ELSE ok || '/' || n || ' sentences supported, ' || un || ' without citation' END AS detail FROM l LEFT JOIN e USING (ord)"""
_CITATION_SUPPORT = f"""{_A}, {_sentences('citation-support')}, e AS (SELECT ord, count(*) AS n, count_if(CASE WHEN len(refs) > 0 THEN {_entails(_premise('refs'), 'claim')} ELSE {_denies('claim')} END) AS ok FROM s WHERE len(string_split(claim, ' ')) >= 3 GROUP BY ord)
  SELECT l.ord, coalesce(n > 0 AND ok = n, FALSE) AS pass, round(coalesce(CAST(ok AS DOUBLE) / n, 0.0), 6) AS score, CASE WHEN n IS NULL THEN 'no sentence' ELSE ok || '/' || n || ' sentences supported or about the documents' END AS detail FROM l LEFT JOIN e USING (ord)"""
_CITATION_PRECISION = f"""{_A}, {_sentences('citation-precision')}, w AS (SELECT *, {_entails(_premise('refs'), 'claim')} AS whole FROM s WHERE len(refs) > 0),
  e AS (SELECT ord, sum(len(refs)) AS total, sum(CASE WHEN NOT whole THEN 0 WHEN len(refs) = 1 THEN 1 ELSE len(list_filter(refs, lambda r: {_entails(_premise('[r]'), 'claim')} OR NOT {_entails(_premise('list_filter(refs, lambda o: o <> r)'), 'claim')})) END) AS good FROM w GROUP BY ord)
  SELECT l.ord, coalesce(total > 0 AND good = total, FALSE) AS pass, round(coalesce(CAST(good AS DOUBLE) / total, 0.0), 6) AS score, coalesce(good, 0) || '/' || coalesce(total, 0) || ' citations necessary' AS detail FROM l LEFT JOIN e USING (ord)"""


def _span_grade(name: str, text: str, what: str) -> str:
    return f"""SELECT ord, model_requests, len(b) = 0 AS pass, 1 - CAST(len(b) AS DOUBLE) / len(protected) AS score, len(b) || '/' || len(protected) || ' {what}' || CASE WHEN len(b) > 0 THEN ': ' || array_to_string(b, ' | ') ELSE '' END AS detail
      FROM (SELECT ord, protected, model_requests, list_filter(protected, lambda p: {span_sql(text, 'p')}) AS b FROM a WHERE list_contains(graders, '{name}') AND len(protected) > 0)"""


_REMOVAL = _span_grade("removal", _O, "protected spans survived")
_LEAKAGE = _span_grade("leakage", "array_to_string(coalesce(model_requests, []), chr(10))", "reached the model")
_RETENTION = f"""{_A}, l AS (SELECT ord, list_reduce(list_filter(protected, lambda x: x <> ''), lambda acc, x: replace(acc, x, ' '), coalesce(input, '')) AS rest, {_O} AS o FROM a WHERE list_contains(graders, 'retention') AND len(protected) > 0),
  w AS (SELECT ord, t, count(*) AS w FROM (SELECT ord, unnest({tokens_sql('rest')}) AS t FROM l) GROUP BY ALL), h AS (SELECT ord, t, count(*) AS h FROM (SELECT ord, unnest({tokens_sql('o')}) AS t FROM l) GROUP BY ALL),
  e AS (SELECT ord, sum(w) AS n, sum(least(w, coalesce(h, 0))) AS k FROM w LEFT JOIN h USING (ord, t) GROUP BY ord)
  SELECT l.ord, coalesce(CAST(k AS DOUBLE) / n, 1.0) >= 0.9 AS pass, round(coalesce(CAST(k AS DOUBLE) / n, 1.0), 6) AS score, coalesce(k, 0) || '/' || coalesce(n, 0) || ' non-protected tokens kept' AS detail FROM l LEFT JOIN e USING (ord)"""

ORACLE = {
    "grd1_exact": f"{_A} SELECT ord, pass, {_ROUND}, detail FROM ({_EXACT})",
    "grd2_str_em": f"{_A} SELECT ord, pass, {_ROUND}, detail FROM ({_STR_EM})",
    "grd3_citation_recall": _CITATION_RECALL,
    "grd4_citation_precision": _CITATION_PRECISION,
    "grd5_clause_recall": f"{_A} SELECT ord, pass, {_ROUND}, detail FROM ({_CLAUSE_RECALL})",
    "grd6_clause_precision": f"{_A} SELECT ord, pass, {_ROUND}, detail FROM ({_CLAUSE_PRECISION})",
    "grd7_citation_support": _CITATION_SUPPORT,
    "grd8_removal": f"{_A} SELECT ord, pass, {_ROUND}, detail FROM ({_REMOVAL})",
    "grd9_leakage": f"{_A} SELECT ord, CASE WHEN model_requests IS NOT NULL THEN pass END AS pass, CASE WHEN model_requests IS NOT NULL THEN round(score, 6) END AS score, CASE WHEN model_requests IS NOT NULL THEN detail ELSE 'not measurable: the requests were not kept' END AS detail FROM ({_LEAKAGE})",
    "grd10_retention": _RETENTION,
    "grd12_gold_problems": """SELECT id, grader, problem FROM (SELECT id, grader, CASE WHEN grader IS NULL THEN 'no graders'
        WHEN grader NOT IN ('exact', 'str-em', 'citation-recall', 'citation-precision', 'clause-recall', 'clause-precision', 'citation-support', 'removal', 'leakage', 'retention') THEN 'unknown grader'
        WHEN grader = 'exact' AND answer IS NULL THEN 'needs an answer' WHEN grader = 'str-em' AND coalesce(len(qaPairs), 0) < 1 THEN 'needs qaPairs'
        WHEN grader IN ('clause-recall', 'clause-precision', 'citation-support') AND clauses IS NULL THEN 'needs clauses'
        WHEN grader IN ('removal', 'leakage', 'retention') AND coalesce(len(protected), 0) < 1 THEN 'needs protected spans'
        WHEN grader IN ('removal', 'leakage', 'retention') AND len(list_filter(protected, lambda s: trim(s) = '')) > 0 THEN 'empty protected span'
        WHEN grader = 'exact' AND there AND coalesce(n_choices, 0) < 1 THEN 'needs choices'
        WHEN grader IN ('clause-recall', 'clause-precision', 'citation-support', 'citation-recall', 'citation-precision') AND there AND coalesce(n_docs, 0) < 1 THEN 'needs docs' END AS problem
      FROM (SELECT p.*, c.id IS NOT NULL AS there, len(c.choices) AS n_choices, len(c.docs) AS n_docs, unnest(CASE WHEN len(graders) > 0 THEN graders ELSE [NULL] END) AS grader FROM private_cases p LEFT JOIN """ + CASES_SQL + """ c ON c.id = p.id)) WHERE problem IS NOT NULL""",
}

#: Every grade that a case lists, from the SQL of the single graders.
_MADE = " UNION ALL ".join(f"SELECT ord, '{name}' AS grader, pass, score FROM ({ORACLE[f'grd{i}_' + name.replace('-', '_')]})" for i, name in enumerate(("exact", "str-em", "citation-recall", "citation-precision", "clause-recall", "clause-precision", "citation-support", "removal", "leakage", "retention"), 1))
ORACLE["grd13_dispatch"] = f"""{_A}, g AS (SELECT ord, error IS NOT NULL AND error <> '' AS failed, graders, unnest(range(0, len(graders))) AS place FROM a), made AS ({_MADE})
  SELECT g.ord, CAST(place AS INTEGER) AS place, graders[place + 1] AS grader, CASE WHEN failed OR made.ord IS NULL THEN FALSE ELSE pass END AS pass, CASE WHEN failed OR made.ord IS NULL THEN 0.0::DOUBLE ELSE score END AS score,
    CASE WHEN failed THEN 'run_error' WHEN made.ord IS NULL THEN 'grade_error' ELSE 'ok' END AS status FROM g LEFT JOIN made ON made.ord = g.ord AND made.grader = g.graders[place + 1]"""
