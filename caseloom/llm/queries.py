"""The training-data operators on the project's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.dedupe import latest_by
from ..plans.session import cut_lineage
from . import mixing, packing, pairs, quantiles, spam, spans, splitting, tokens


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    """Each record once, its latest load, with the columns given as name=expression."""
    raw = _table(spark, d, "results").select("ord", "loaded_at", *[F.expr(e).alias(n) for n, e in columns.items()])
    return latest_by(raw, ["ord"], "loaded_at")


def _cases(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    """Each case once, its latest import."""
    raw = _table(spark, d, "public_cases").select("id", "imported_at", *[F.expr(e).alias(n) for n, e in columns.items()])
    return latest_by(raw, ["id"], "imported_at")


def _passages(cases: DataFrame) -> DataFrame:
    return cases.select("id", F.posexplode("docs").alias("place", "doc")).select(F.col("id").alias("case_id"), (F.col("place") + 1).alias("passage"), F.col("doc.text").alias("text"))


# 1 percentiles

RANKS = (0.5, 0.9, 0.95, 0.99)
METRICS = {"latencyMs": "run.latencyMs", "costUsd": "run.costUsd"}


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """system, day, metric, value: each record's measures once; the day is that of the run, from its name."""
    one = _records(spark, d, system="run.system", day="left(run_id, 10)", **METRICS)
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])).alias("m")
    return one.select("system", "day", both).select("system", "day", "m.metric", "m.value")


def p1_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The summaries of single days, to be kept and combined."""
    return quantiles.summaries(_measures(spark, d), ["system", "day", "metric"], "value")


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    days = cut_lineage(p1_summaries(spark, d))
    by_day = quantiles.percentiles(days, ["system", "day", "metric"], RANKS)
    whole = quantiles.percentiles(quantiles.merged(days, ["system", "metric"]), ["system", "metric"], RANKS)
    out = by_day.unionByName(whole.withColumn("day", F.lit(None).cast("string")))
    return out.select("system", "day", "metric", "n", "q", F.round("value", 9).alias("value"), "rank_error", "value_error")


def p1_within_error(spark: SparkSession, d: str) -> DataFrame:
    """Per system, measure and percentile, and per day too: whether the summaries' answer holds its errors against the values
    themselves: as many lie below (by more than the value's error), and as many up to it, as its rank allows."""
    values = cut_lineage(_measures(spark, d).where("value is not null and not isnan(value)").groupBy("system", "day", "metric", "value").agg(F.count("*").alias("count")))
    said = p1_percentiles(spark, d).select("system", "day", "metric", "n", "q", F.col("value").alias("said"), "rank_error", "value_error")
    both = values.withColumn("day", F.explode(F.array("day", F.lit(None).cast("string")))).groupBy("system", "day", "metric", "value").agg(F.sum("count").alias("count"))
    same = [both[c].eqNullSafe(said[c]) for c in ("system", "day", "metric")]
    each = both.join(said.hint("merge"), same[0] & same[1] & same[2]).select(said["system"], said["day"], said["metric"], "n", "q", "said", "rank_error", "value_error", "value", "count")
    reach = F.abs("said") * F.col("value_error") * 1.001 + 1e-9
    sums = each.groupBy("system", "day", "metric", "q", "n", "rank_error").agg(
        F.sum("count").alias("held"), F.sum(F.when(F.col("value") < F.col("said") - reach, F.col("count")).otherwise(0)).alias("below"), F.sum(F.when(F.col("value") <= F.col("said") + reach, F.col("count")).otherwise(0)).alias("upto")
    )
    slack = F.col("rank_error") * F.col("n") + 1
    good = (F.col("below") <= F.col("q") * F.col("n") + slack) & (F.col("upto") >= F.col("q") * F.col("n") - slack)
    return sums.select("system", "day", "metric", "q", F.col("held").alias("n"), (good & (F.col("held") == F.col("n"))).alias("within_error"))


# 2 splitting


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # pieces of both imports of a case are made and only their keys are shuffled: cheaper than one import's texts
    raw = _table(spark, d, "public_cases").select("id", "imported_at", F.posexplode("docs").alias("place", "doc"))
    long = raw.select(F.col("id").alias("case_id"), (F.col("place") + 1).alias("passage"), "imported_at", F.col("doc.text").alias("text"))
    # a stretch without white space counts as forced even where it could be cut after a full stop of its script
    long = long.withColumn("unbroken", F.col("text").rlike(r"[^\s\x1c-\x1f\x{85}\p{Z}]{2001}"))
    pieces = splitting.split_oversized(long, "text", ["case_id", "passage", "imported_at", "unbroken"], with_text=False)
    cut = pieces.groupBy("case_id", "passage", "imported_at").agg(F.max((F.col("boundary") == "forced") | F.col("unbroken")).alias("forced"))
    one = cut.groupBy("case_id", "passage").agg(F.max_by("forced", "imported_at").alias("forced"))
    return one.select("case_id", "passage", F.when(F.col("forced"), "forced").otherwise("boundary").alias("cut"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_passages(_cases(spark, d, docs="docs")), "text", ["case_id", "passage"])


def p2_whole(spark: SparkSession, d: str) -> DataFrame:
    """Per long passage: whether its pieces cover it without a gap, in order, none longer than 2,000 and none beginning more
    than 200 characters before the end of the one before."""
    texts = _passages(_cases(spark, d, docs="docs")).select("case_id", "passage", F.length("text").alias("n_chars"))
    own = Window.partitionBy("case_id", "passage").orderBy("piece")
    p = p2_pieces(spark, d).withColumn("before", F.lag("end").over(own)).join(texts, ["case_id", "passage"])
    start = F.coalesce(F.col("start").between(F.col("before") - 200, F.col("before")) & (F.col("end") > F.col("before")), (F.col("piece") == 1) & (F.col("start") == 0))
    fits = (F.col("end") - F.col("start") <= 2000) & (F.length("piece_text") == F.col("end") - F.col("start"))
    return p.groupBy("case_id", "passage").agg(F.max("n_chars").alias("n_chars"), (F.min(start & fits) & (F.max("end") == F.max("n_chars"))).alias("whole"))


# 3 broken pairs

#: Where the passages of an input begin; what stands before them is the question.
PASSAGES = r"\n\nDocument \[1\]"


def _languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [pairs.case_language(q or "", t or "") for q, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["case_id", "allowed"])


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Every record that has a case, beside the case; its input wherever that can change the judgement."""
    out = _records(spark, d, case_id="run.caseId", output="run.output").withColumnRenamed("ord", "key")
    rewrite = F.col("suite") == "redaction"
    asked = F.regexp_replace(F.coalesce("question", F.get(F.split("input", PASSAGES), 0)), r"^\s*Question:\s*", "")
    cases = _cases(spark, d, suite="suite", topic="task", question="question", input="input", instructions="instructions", choices="choices")
    cases = cases.select(F.col("id").alias("case_id"), "topic", rewrite.alias("rewrite"), F.when(rewrite, F.lit("")).otherwise(asked).alias("question"), "input", pairs.words_in(F.col("input")).alias("input_words"), "instructions", "choices")
    told = cases.select("case_id", "question", "input").mapInArrow(_languages, "case_id string, allowed string")
    both = out.join(cases.join(told, "case_id"), "case_id")
    return both.withColumn("prompt", F.when(pairs.needs_prompt(F.col("output"), F.col("input_words"), F.col("rewrite")), F.col("input")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    seen = cut_lineage(pairs.responses(_responses(spark, d)))
    return pairs.defects(seen).select(F.col("key").alias("ord"), "defect")


# 6 shared spans


def _span_records(spark: SparkSession, d: str) -> DataFrame:
    """Outputs and passages under their names, with the time of loading or import as version."""
    out = _table(spark, d, "results").select(F.concat(F.lit("result:"), "ord").alias("rec"), F.col("run.output").alias("text"), F.col("loaded_at").alias("version"))
    docs = _table(spark, d, "public_cases").select("id", "imported_at", F.posexplode("docs.text").alias("place", "text"))
    case = docs.select(F.concat(F.lit("case:"), "id", F.lit("#"), F.col("place") + 1).alias("rec"), "text", F.col("imported_at").alias("version"))
    return out.unionByName(case)


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between different texts, each named by the first of its copies, with the shared parts of both as from-to."""
    links, _ = spans.shared_spans(_span_records(spark, d), version="version")
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["s"].cast("string"), F.lit("-"), x["e"].cast("string"))), ",").alias(c)
    return links.select("rec_a", "rec_b", told("spans_a"), told("spans_b"))


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """The records that share something, each with the first of its copies."""
    links, members = spans.shared_spans(_span_records(spark, d), version="version")
    linked = links.select(F.explode(F.array("rec_a", "rec_b")).alias("rep")).unionByName(members.groupBy("rep").count().where("count > 1").select("rep")).distinct()
    return members.join(linked.hint("merge"), "rep", "left_semi").select("rec", "rep", "n_chars")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = spans.shared_spans(_span_records(spark, d), version="version")
    return spans.all_pairs(links, members)


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    links, members = spans.shared_spans(_span_records(spark, d), version="version")
    return spans.shared_shares(latest_by(_span_records(spark, d), ["rec"], "version", wide=True), links, members)


# 7 packing


def _capacities(spark: SparkSession, d: str) -> dict[int, int]:
    """A handful of settings; more than a thousand are a mistake."""
    rows = _table(spark, d, "pack_specs").select("spec_id", "capacity_tokens").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 capacities")
    return {r[0]: r[1] for r in rows if r[1] and r[1] > 0}


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    sized = cut_lineage(packing.with_tokens(_table(spark, d, "documents"), "doc_id", "text"))
    return packing.pack_documents(sized, _capacities(spark, d), "doc_id", vocabulary_size=tokens.size_of_vocabulary(tokens.vocabulary()))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(cut_lineage(p7_packed(spark, d)), _table(spark, d, "pack_specs"), "doc_id")


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: whether every document is there with all its tokens, in one piece unless too large, no container holds
    too much, and few are needed: at most 2 % more than the tokens ask for, and one."""
    packed = cut_lineage(p7_packed(spark, d))
    sized = packing.with_tokens(_table(spark, d, "documents"), "doc_id", "text", terms=False)
    specs = _table(spark, d, "pack_specs").select("spec_id", "capacity_tokens")
    doc = packed.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("inside"), F.count("*").alias("parts"))
    doc = doc.join(F.broadcast(specs), "spec_id").join(sized, "doc_id", "full")
    good = (F.col("inside") == F.col("tokens")) & (F.col("parts") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity_tokens"))))
    per = doc.groupBy("spec_id").agg(F.count("*").alias("documents"), F.min(F.coalesce(good, F.lit(False))).alias("whole"))
    held = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("inside")).join(F.broadcast(specs), "spec_id")
    few = F.count("*") <= 1.02 * F.ceil(F.sum("inside") / F.max("capacity_tokens")) + 1
    held = held.groupBy("spec_id").agg((F.max(F.col("inside") - F.col("capacity_tokens")) <= 0).alias("within_capacity"), few.alias("well_filled"))
    return per.join(held, "spec_id").select("spec_id", "documents", "whole", "within_capacity", "well_filled")


# 8 mixing


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(packing.with_tokens(_table(spark, d, "documents"), "doc_id", "text", terms=False, keep=["source"]))


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(_sized(spark, d), _table(spark, d, "mix_targets"), "doc_id")[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    mixed, parts = mixing.mix_documents(_sized(spark, d), _table(spark, d, "mix_targets"), "doc_id")
    return mixing.shares_reached(mixed, parts, "doc_id")


def p8_within(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source: whether no document is used too often, the tokens are the target's share of the mix within two of its
    largest documents, and the mix is as large as asked for or its scarcest source is used up."""
    r = p8_shares(spark, d)
    mix = r.groupBy("mix_id").agg(F.sum("tokens").alias("given"), F.sum("wanted_tokens").alias("wanted"), F.max(F.col("tokens") + F.coalesce("largest", F.lit(0)) >= F.col("source_tokens") * F.col("max_repeats")).alias("used_up"), F.max("largest").alias("most"))
    r = r.join(mix, "mix_id")
    full = (F.col("given") >= 0.99 * F.col("wanted")) | F.col("used_up")
    good = (F.col("most_uses") <= F.col("max_repeats")) & (F.abs(F.col("tokens") - F.col("target_share") * F.col("given")) <= 2 * F.col("most")) & full
    return r.select("mix_id", "source", "target_share", good.alias("within"))


def p8_deviation(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source: whether its tokens, at the end of every slot of the mix, are within a block and a document of its
    share of the slots so far."""
    mixed, parts = mixing.mix_documents(_sized(spark, d), _table(spark, d, "mix_targets"), "doc_id")
    worst = mixing.running_deviation(mixed, parts)
    targets = _table(spark, d, "mix_targets").select("mix_id", "source")
    return targets.join(worst, ["mix_id", "source"], "left").select("mix_id", "source", F.coalesce(F.col("deviation") <= F.col("bound"), F.lit(True)).alias("within"))


# 9 spam


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    out = spam.spam_scores(_table(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", "language", F.round("spam_share", 6).alias("spam_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(_table(spark, d, "documents"), "doc_id", "text").where("spam_share > 0.5").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_percentiles, p1_summaries, p1_within_error, p2_found, p2_pieces, p2_whole, p3_found, p6_found, p6_links, p6_members, p6_shares, p7_packed, p7_report, p7_whole, p8_mixed, p8_shares, p8_within, p8_deviation, p9_found, p9_scores)
}

_LATEST = "(SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY ord ORDER BY loaded_at DESC) = 1)"

#: All windows of 200 characters that more than one record has, by their hash.
_SPANS = f"""WITH t AS (SELECT 'result:' || ord AS rec, run.output AS text FROM {_LATEST} UNION ALL SELECT 'case:' || id || '#' || k, docs[k].text FROM (SELECT id, docs, unnest(generate_series(1, len(docs))) AS k FROM (SELECT * FROM public_cases QUALIFY row_number() OVER (PARTITION BY id ORDER BY imported_at DESC) = 1))),
    x AS (SELECT rec, text, unnest(range(1, length(text) - 198)) AS pos FROM t WHERE length(text) >= 200), y AS (SELECT rec, pos, md5_number(substring(text, pos, 200)) AS h FROM x), w AS (SELECT * FROM y WHERE h IN (SELECT h FROM y GROUP BY h HAVING count(DISTINCT rec) > 1))"""

ORACLE: dict[str, str] = {
    "p1_within_error": f"""
        WITH l AS {_LATEST}, m AS (SELECT run.system AS system, left(run_id, 10) AS day, 'latencyMs' AS metric, CAST(run.latencyMs AS DOUBLE) AS v FROM l UNION ALL SELECT run.system, left(run_id, 10), 'costUsd', run.costUsd FROM l),
             g AS (SELECT system, day, metric, count(v) AS n FROM m GROUP BY ALL UNION ALL SELECT system, NULL, metric, count(v) FROM m GROUP BY ALL)
        SELECT system, day, metric, q, n, TRUE AS within_error FROM g, (VALUES (CAST(0.5 AS DOUBLE)), (0.9), (0.95), (0.99)) t(q) WHERE n > 0""",
    "p6_links": f"""{_SPANS}, k AS (SELECT min(rec) AS rec FROM t WHERE length(text) >= 200 GROUP BY text), v AS (SELECT * FROM w WHERE rec IN (SELECT rec FROM k)),
        e AS (SELECT a.rec AS rec_a, b.rec AS rec_b, a.pos AS pa, b.pos AS pb FROM v a JOIN v b ON a.h = b.h AND a.rec < b.rec),
        sa AS (SELECT rec_a, rec_b, pos, sum(CASE WHEN pos - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_a, rec_b ORDER BY pos) AS g FROM (SELECT rec_a, rec_b, pa AS pos, lag(pa) OVER (PARTITION BY rec_a, rec_b ORDER BY pa) AS before FROM (SELECT DISTINCT rec_a, rec_b, pa FROM e))),
        sb AS (SELECT rec_a, rec_b, pos, sum(CASE WHEN pos - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_a, rec_b ORDER BY pos) AS g FROM (SELECT rec_a, rec_b, pb AS pos, lag(pb) OVER (PARTITION BY rec_a, rec_b ORDER BY pb) AS before FROM (SELECT DISTINCT rec_a, rec_b, pb FROM e))),
        la AS (SELECT rec_a, rec_b, string_agg((s - 1) || '-' || (e + 199), ',' ORDER BY s) AS spans_a FROM (SELECT rec_a, rec_b, min(pos) AS s, max(pos) AS e FROM sa GROUP BY rec_a, rec_b, g) GROUP BY ALL),
        lb AS (SELECT rec_a, rec_b, string_agg((s - 1) || '-' || (e + 199), ',' ORDER BY s) AS spans_b FROM (SELECT rec_a, rec_b, min(pos) AS s, max(pos) AS e FROM sb GROUP BY rec_a, rec_b, g) GROUP BY ALL)
        SELECT rec_a, rec_b, spans_a, spans_b FROM la JOIN lb USING (rec_a, rec_b)""",
    "p6_members": f"{_SPANS} SELECT t.rec, k.rep, CAST(length(t.text) AS INTEGER) AS n_chars FROM t JOIN (SELECT text, min(rec) AS rep FROM t WHERE length(text) >= 200 GROUP BY text) k USING (text) WHERE t.rec IN (SELECT rec FROM w)",
    "p6_found": f"{_SPANS} SELECT DISTINCT a.rec AS rec_a, b.rec AS rec_b FROM w a JOIN w b ON a.h = b.h AND a.rec < b.rec",
    "p6_shares": f"""{_SPANS}, p AS (SELECT rec, pos, lead(pos) OVER (PARTITION BY rec ORDER BY pos) AS later FROM (SELECT DISTINCT rec, pos FROM w)), c AS (SELECT rec, sum(least(200, coalesce(later - pos, 200))) AS shared FROM p GROUP BY rec),
        o AS (SELECT a.rec, count(DISTINCT b.rec) AS partners FROM w a JOIN w b ON a.h = b.h AND a.rec <> b.rec GROUP BY a.rec)
        SELECT rec, CAST(length(text) AS INTEGER) AS n_chars, CAST(coalesce(shared, 0) AS INTEGER) AS shared_chars, CASE WHEN length(text) > 0 THEN round(CAST(coalesce(shared, 0) AS DOUBLE) / length(text), 6) END AS share, coalesce(partners, 0) AS partners FROM t LEFT JOIN c USING (rec) LEFT JOIN o USING (rec)""",
    "p2_whole": """SELECT id AS case_id, CAST(passage AS INTEGER) AS passage, CAST(length(docs[passage].text) AS INTEGER) AS n_chars, TRUE AS whole
        FROM (SELECT id, docs, unnest(generate_series(1, len(docs))) AS passage FROM (SELECT * FROM public_cases QUALIFY row_number() OVER (PARTITION BY id ORDER BY imported_at DESC) = 1)) WHERE length(docs[passage].text) > 2000""",
    "p8_within": "SELECT mix_id, source, share AS target_share, TRUE AS within FROM mix_targets",
    "p8_deviation": "SELECT mix_id, source, TRUE AS within FROM mix_targets",
    "p7_whole": "SELECT spec_id, (SELECT count(*) FROM documents) AS documents, TRUE AS whole, TRUE AS within_capacity, TRUE AS well_filled FROM pack_specs",
    "p2_found": r"""
        WITH c AS (SELECT * FROM public_cases QUALIFY row_number() OVER (PARTITION BY id ORDER BY imported_at DESC) = 1),
             p AS (SELECT id, docs, unnest(generate_series(1, len(docs))) AS passage FROM c),
             t AS (SELECT id, passage, docs[passage].text AS text FROM p WHERE length(docs[passage].text) > 2000)
        SELECT id AS case_id, CAST(passage AS INTEGER) AS passage,
               CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: length(x))) > 2000 THEN 'forced' ELSE 'boundary' END AS cut
        FROM t""",
}
