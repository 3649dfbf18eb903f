"""Text functions as queries over the project's texts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .views import ANSWERS_SQL, CASES_SQL, RECORDS_SQL, answers, cases, gold, records, table

_WS = X.WS


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("ord", "case_id", "output")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _over_docs(column):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _docs(spark, d).select("doc_id", column(F.col("text")).alias("value"))

    return query


def _over_outputs(column):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _outputs(spark, d).select("ord", column(F.col("output")).alias("value"))

    return query


def _joined(xs):
    return F.array_join(xs, "␟")


# SQL of the same functions
def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+\\z', '', 'g')"


def collapse_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")


def escape_sql(x: str) -> str:
    return rf"regexp_replace({x}, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g')"


def norm_sql(x: str) -> str:
    return f"lower({collapse_sql(rf'''regexp_replace({x}, '[^\p{{L}}\p{{N}}{_WS[1:-1]}]', '', 'g')''')})"


def label_sql(x: str) -> str:
    return f"""regexp_replace(regexp_replace(lower({strip_sql(x)}), '[.!?"''`*]+\\z', ''), '^["''`*]+', '')"""


def answer_sql(x: str) -> str:
    return collapse_sql(rf"regexp_replace(regexp_replace(lower({x}), '{X.PUNCTUATION}', '', 'g'), '\b(a|an|the)\b', ' ', 'g')")


def sentences_sql(x: str) -> str:
    marked = rf"""regexp_replace({x}, '([.!?]){_WS}+([A-Z0-9"''(\[])', '\1␞\2', 'g')"""
    return f"list_filter(list_transform(string_split({marked}, '␞'), lambda q: {strip_sql('q')}), lambda q: q <> '')"


def cites_sql(x: str, n: str, close: str = "") -> str:
    found = rf"list_transform(regexp_extract_all({x}, '\[([0-9]+){close}', 1), lambda v: try_cast(v AS BIGINT) - 1)"
    kept = f"list_filter({found}, lambda v: v >= 0 AND v < {n})"
    return f"list_filter({kept}, lambda v, i: list_position({kept}, v) = i)"


def uncite_sql(x: str) -> str:
    return collapse_sql(rf"regexp_replace({x}, '{_WS}*\[[0-9]+\]', '', 'g')")


def flexible_sql(x: str) -> str:
    ws = _WS.replace("\\", "\\\\")
    return f"regexp_replace({escape_sql(strip_sql(x))}, '{_WS}+', '{ws}+', 'g')"


def span_sql(text: str, span: str) -> str:
    return rf"({strip_sql(span)} <> '' AND regexp_matches({text}, '(?i)(^|[^\p{{L}}\p{{N}}])' || {flexible_sql(span)} || '([^\p{{L}}\p{{N}}]|$)'))"


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]{{3,}}')"


PII_SQL = (
    ("email", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"),
    ("phone", r"\+?[0-9][0-9 .-]{7,}[0-9]"),
    ("ipv4", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("ipv6", r"(?i)\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b"),
)


def scrub_sql(x: str, upto: int = 4) -> str:
    for _, p in PII_SQL[:upto]:
        x = f"regexp_replace({x}, '{p}', '[REDACTED]', 'g')"
    return x


def findings_sql(x: str) -> str:
    return " || ".join(f"list_transform(regexp_extract_all({scrub_sql(x, i)}, '{p}'), lambda v: '{label}:' || v)" for i, (label, p) in enumerate(PII_SQL))


def run_sql(claim: str, text: str) -> str:
    """Longest run by all pairs of first and last word, for short claims."""
    w = f"string_split({claim}, ' ')"
    return f"list_max(list_transform(generate_series(1, len({w})), lambda a: list_max(list_transform(generate_series(0, len({w})), lambda n: CASE WHEN a + n - 1 <= len({w}) AND (n = 0 OR contains({text}, array_to_string({w}[a:a + n - 1], ' '))) THEN n ELSE 0 END))))"


QUERIES = {
    "str1_escape": _over_outputs(X.escape_pattern),
    "str2_normalize_words": _over_docs(X.normalize_words),
    "str3_normalize_label": _over_outputs(X.normalize_label),
    "str4_normalize_answer": _over_docs(X.normalize_answer),
    "str6_sentences": _over_docs(lambda x: _joined(X.sentences(x))),
    "str10_remove_citations": _over_outputs(X.remove_citations),
    "str14_tokens": _over_docs(lambda x: _joined(X.tokens(x))),
    "str15_strip_reasoning": _over_outputs(X.strip_reasoning),
    "str16_says_yes": _over_outputs(X.says_yes),
    "str17_verdict": _over_outputs(X.verdict_word),
    "str19_scrub": _over_docs(X.scrub),
    "str19_findings": _over_docs(lambda x: _joined(X.scrub_findings(x))),
    "str22_bracketed_list": _over_outputs(lambda x: _joined(X.bracketed_list(x))),
    "str23_quote_lines": _over_outputs(lambda x: _joined(F.transform(X.quote_lines(x), lambda q: F.concat(q["passage"].cast("string"), F.lit(":"), q["text"])))),
    "str24_bare_lines": _over_docs(lambda x: _joined(X.bare_lines(x))),
    "str25_insert_citations": _over_outputs(lambda x: X.insert_citations(x, F.lit("[1]"))),
    "str27_collapse": _over_docs(X.collapse),
    "str28_words": _over_docs(X.word_count),
    "str28_split_count": _over_docs(X.split_count),
    "str32_html_escape": _over_outputs(X.html_escape),
}

_DOC_SQL = {
    "str2_normalize_words": norm_sql("text"), "str4_normalize_answer": answer_sql("text"), "str6_sentences": f"array_to_string({sentences_sql('text')}, '␟')",
    "str14_tokens": f"array_to_string({tokens_sql('text')}, '␟')", "str19_scrub": scrub_sql("text"), "str19_findings": f"array_to_string({findings_sql('text')}, '␟')",
    "str24_bare_lines": rf"""array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda q: {strip_sql(rf'''regexp_replace(regexp_replace(q, '^{_WS}*(?:\[[0-9]+\]|[-*•]|[0-9]+[.)])?{_WS}*', ''), '(?s)^"(.*)"\z', '\1')''')}), lambda q: q <> '' AND NOT regexp_matches(q, '(?i)^none\b')), '␟')""",
    "str27_collapse": collapse_sql("text"), "str28_words": f"CAST(len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda q: q <> '')) AS INTEGER)", "str28_split_count": f"CAST(len(regexp_split_to_array(text, '{_WS}+')) AS INTEGER)",
}
_ITEMS = f"list_filter(list_transform(CASE WHEN json_valid(regexp_extract(output, '(?s)\\[.*\\]', 0)) THEN from_json(regexp_extract(output, '(?s)\\[.*\\]', 0), '[\"VARCHAR\"]') ELSE [] END, lambda x: {strip_sql('x')}), lambda x: length(x) >= 2)"
_OUT_SQL = {
    "str22_bracketed_list": f"array_to_string(list_filter({_ITEMS}, lambda x, i: list_position({_ITEMS}, x) = i), '␟')",
    "str1_escape": escape_sql("output"), "str3_normalize_label": label_sql("output"), "str10_remove_citations": uncite_sql("output"),
    "str15_strip_reasoning": strip_sql("regexp_replace(output, '(?s)<think>.*?</think>', '', 'g')"), "str16_says_yes": rf"regexp_matches(output, '(?i)^{_WS}*yes\b')",
    "str17_verdict": r"CASE WHEN output IS NOT NULL THEN coalesce(nullif(lower(regexp_extract(output, '(?i)\b(yes|keep|no)\b', 1)), ''), 'no') END",
    "str23_quote_lines": rf"""array_to_string(list_transform(list_filter(string_split(output, chr(10)), lambda q: regexp_matches(q, '^{_WS}*\[[0-9]+\]{_WS}*"?.+?"?{_WS}*\z')), lambda q: CAST(CAST(regexp_extract(q, '^{_WS}*\[([0-9]+)\]', 1) AS BIGINT) - 1 AS VARCHAR) || ':' || {strip_sql(rf'''regexp_extract(q, '^{_WS}*\[([0-9]+)\]{_WS}*"?(.+?)"?{_WS}*\z', 2)''')}), '␟')""",
    "str25_insert_citations": r"regexp_extract(output, '(?s)^(.*?)([.!?]*)\z', 1) || ' [1]' || regexp_extract(output, '(?s)^(.*?)([.!?]*)\z', 2)",
    "str32_html_escape": "replace(replace(replace(replace(output, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')",
}
ORACLE = {k: f"SELECT doc_id, {v} AS value FROM documents" for k, v in _DOC_SQL.items()} | {k: f"SELECT ord, {v} AS value FROM {RECORDS_SQL}" for k, v in _OUT_SQL.items()}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_A = f"WITH a AS {ANSWERS_SQL}"
_CHOICE = rf"list_filter(list_transform(choices, lambda c: {label_sql('c')}), lambda c: regexp_matches(output, '(?i)\b' || {escape_sql('c')} || '\b'))"
CHOICE_SQL = f"CASE WHEN list_contains(list_transform(choices, lambda c: {label_sql('c')}), {label_sql('output')}) THEN {label_sql('output')} WHEN list_contains(list_transform(choices, lambda c: {label_sql('c')}), {label_sql('string_split(output, chr(10))[1]')}) THEN {label_sql('string_split(output, chr(10))[1]')} WHEN len({_CHOICE}) = 1 THEN {_CHOICE}[1] END"


@_query(f"{_A} SELECT ord, {CHOICE_SQL} AS choice FROM a WHERE choices IS NOT NULL")
def str5_extract_choice(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).where("choices is not null").select("ord", X.extract_choice("output", "choices").alias("choice"))


@_query(f"{_A} SELECT ord, {cites_sql('output', 'len(docs)')} AS cited FROM a WHERE docs IS NOT NULL")
def str8_citations(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).where("docs is not null").select("ord", X.citations("output", F.size("docs")).alias("cited"))


@_query(rf"{_A} SELECT ord, {cites_sql('output', 'len(docs)', chr(92) + ']')} AS cited FROM a WHERE docs IS NOT NULL")
def str9_citations_closed(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).where("docs is not null").select("ord", X.citations_closed("output", F.size("docs")).alias("cited"))


_CLAUSES = f"WITH g AS (SELECT p.id, unnest(generate_series(1, len(clauses))) AS k, clauses, c.docs FROM private_cases p JOIN {CASES_SQL} c ON c.id = p.id), t AS (SELECT id, k, {norm_sql('clauses[k].text')} AS claim, {norm_sql('''array_to_string(list_transform(docs, lambda x: coalesce(x.text, '')), chr(10))''')} AS hay FROM g WHERE clauses[k].text IS NOT NULL)"


def _clause_texts(spark: SparkSession, d: str) -> DataFrame:
    both = gold(spark, d).select("id", "clauses").join(cases(spark, d).select("id", "docs"), "id")
    flat = both.select("id", "docs", F.posexplode("clauses").alias("p", "c")).where(F.col("c.text").isNotNull())
    hay = F.array_join(F.transform("docs", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return flat.select("id", (F.col("p") + 1).cast("bigint").alias("k"), F.col("c.text").alias("claim"), F.coalesce(hay, F.lit(None)).alias("hay"))


@_query(f"{_CLAUSES} SELECT id, k, CAST({run_sql('claim', 'hay')} AS INTEGER) AS run FROM t")
def str7_longest_run(spark: SparkSession, d: str) -> DataFrame:
    return _clause_texts(spark, d).select("id", "k", X.longest_run("claim", "hay").alias("run"))


@_query(f"{_CLAUSES} SELECT id, k, {run_sql('claim', 'hay')} >= 8 AS quoted FROM t")
def str7_has_run(spark: SparkSession, d: str) -> DataFrame:
    return _clause_texts(spark, d).select("id", "k", X.has_run("claim", "hay", 8).alias("quoted"))


@_query(f"SELECT id, CASE WHEN docs IS NOT NULL THEN array_to_string(list_transform(docs, lambda x, i: 'Document [' || i || '](Title: ' || coalesce(x.title, '') || '): ' || coalesce(x.text, '')), chr(10)) END AS prompt, CASE WHEN docs IS NOT NULL THEN array_to_string(list_transform(docs[1:2], lambda x: 'Title: ' || coalesce(x.title, '') || chr(10) || coalesce(x.text, '')), chr(10)) END AS first_two FROM {CASES_SQL}")
def str12_format_docs(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    places = F.filter(F.array(F.lit(0), F.lit(1)), lambda i: i < F.size("docs"))
    return c.select("id", X.format_docs(F.col("docs")).alias("prompt"), X.passages_text(F.col("docs"), F.when(F.col("docs").isNotNull(), places)).alias("first_two"))


@_query(f"{_A}, s AS (SELECT ord, output, unnest(protected) AS span FROM a) SELECT ord, span, {span_sql('output', 'span')} AS found FROM s WHERE output IS NOT NULL AND span IS NOT NULL")
def str13_contains_span(spark: SparkSession, d: str) -> DataFrame:
    s = answers(spark, d).select("ord", "output", F.explode("protected").alias("span")).where("output is not null and span is not null")
    return s.select("ord", "span", X.contains_span("output", "span").alias("found"))


_ASKED = strip_sql(r"coalesce(question, regexp_extract(input, '(?s)^(.*?)(?:\n\nDocument \[1\]|\z)', 1))")


@_query(rf"""SELECT id, coalesce(nullif(regexp_extract(input, 'contain a "([^"]+)" clause', 1), ''), 'such') AS clause_type, {_ASKED} AS asked FROM {CASES_SQL}""")
def str18_clause_type(spark: SparkSession, d: str) -> DataFrame:
    asked = X.strip(F.coalesce("question", F.get(F.split("input", r"\n\nDocument \[1\]"), 0)))
    return cases(spark, d).select("id", X.clause_type("input").alias("clause_type"), asked.alias("asked"))


@_query(f"{_A} SELECT ord, list_reduce(list_filter(protected, lambda x: {strip_sql('x')} <> ''), lambda acc, x: regexp_replace(acc, '(?i)' || {flexible_sql('x')}, '[REDACTED]', 'g'), input) AS value FROM a WHERE protected IS NOT NULL")
def str20_scrub_items(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d).where("protected is not null").select("ord", "input", "protected")
    return a.select("ord", X.scrub_items("input", "protected").alias("value"))


@_query(f"SELECT id, list_reduce(list_filter(p.protected, lambda x: x <> ''), lambda acc, x: replace(acc, x, ' '), c.input) AS value FROM private_cases p JOIN {CASES_SQL} c USING (id) WHERE p.protected IS NOT NULL AND len(p.protected) > 0")
def str21_remove_spans(spark: SparkSession, d: str) -> DataFrame:
    both = gold(spark, d).select("id", "protected").join(cases(spark, d).select("id", "input"), "id").where("size(protected) > 0")
    return both.select("id", X.remove_spans("input", "protected").alias("value"))


@_query("SELECT doc_id, coalesce(source, 'none') || '-' || CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents")
def str26_padded_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.padded_id(F.coalesce("source", F.lit("none")), F.col("doc_id")).alias("id"))


@_query(f"SELECT id, instructions || array_to_string(list_transform(coalesce(examples, []), lambda e: chr(10) || chr(10) || e.q || chr(10) || 'Answer: ' || e.a), '') || chr(10) || chr(10) || input || chr(10) || 'Answer:' AS prompt FROM {CASES_SQL}")
def str29_prompt(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.systems import few_shot_prompt

    return cases(spark, d).select("id", few_shot_prompt(F.col("instructions"), F.col("examples"), F.col("input")).alias("prompt"))


@_query("SELECT id, CASE WHEN len(clauses) = 0 THEN 'The contract has no such clause.' ELSE 'The contract has the clause, which reads: ' || array_to_string(list_transform(clauses, lambda c: '\"' || c.text || '\" ' || array_to_string(list_transform(c.passages, lambda i: '[' || (i + 1) || ']'), '')), ' and also: ') || '.' END AS answer FROM private_cases WHERE clauses IS NOT NULL")
def str30_demo_answer(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.dataset import demo_answer

    return gold(spark, d).where("clauses is not null").select("id", demo_answer(F.col("clauses")).alias("answer"))


@_query("SELECT name, regexp_replace(dir || ':' || name, '[^a-zA-Z0-9_.-]', '-', 'g') AS container FROM systems")
def str31_container_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "systems").select("name", X.container_name(F.concat("dir", F.lit(":"), "name")).alias("container"))


@_query("SELECT DISTINCT run.caseId AS case_id, regexp_replace(run.caseId, '-[0-9]+\\z', '') AS suite FROM results")
def str34_suite_of_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").select(F.col("run.caseId").alias("case_id")).distinct().select("case_id", X.suite_of_case("case_id").alias("suite"))


@_query(f"{_A}, s AS (SELECT ord, output, docs[1].text AS first FROM a WHERE len(docs) > 0) SELECT ord, contains({norm_sql('first')}, {norm_sql('output')}) AS inside FROM s WHERE first IS NOT NULL AND output IS NOT NULL")
def str35_contains(spark: SparkSession, d: str) -> DataFrame:
    s = answers(spark, d).where("size(docs) > 0").select("ord", "output", F.get("docs", 0).getField("text").alias("first")).where("first is not null and output is not null")
    return s.select("ord", X.contains_normalized("first", "output").alias("inside"))
