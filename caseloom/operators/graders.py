"""Graders: an answer beside its case and gold in, one grade out; all as column expressions or joins.

answers: ord, case_id, output, error, model_requests, input, docs, choices, answer, qaPairs, clauses, protected, graders.
A grade is ord, grader, pass, score, extracted, detail. A grader looks only at the records whose case lists it; records with
a run error fail every grade; gold that doesn't fit the grader (see `gold_problems`) fails the grade with status grade_error.
"""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import ratio
from ..plans.session import cut_lineage
from . import judge as J

QUOTE_WORDS, MIN_WORDS, RETAINED = 8, 3, 0.9

GRADE = ["ord", "grader", "pass", "score", "extracted", "detail"]


def _text(c: str) -> Column:
    return F.coalesce(c, F.lit(""))


def _fraction(a: Column, b: Column, what: str) -> Column:
    return F.concat(a.cast("string"), F.lit("/"), b.cast("string"), F.lit(what))


def _grade(df: DataFrame, name: str, passed: Column, score: Column, detail: Column, extracted: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("ord", F.lit(name).alias("grader"), passed.alias("pass"), score.cast("double").alias("score"), (extracted if extracted is not None else none).alias("extracted"), detail.alias("detail"))


def listed(answers: DataFrame, name: str) -> DataFrame:
    return answers.where(F.array_contains("graders", name))


def exact(answers: DataFrame) -> DataFrame:
    """The label in the output equals the gold label."""
    a = listed(answers, "exact").where("choices is not null and answer is not null")
    found = F.coalesce(X.extract_choice(_text("output"), "choices"), F.lit("(none)"))
    label = X.normalize_label("answer")
    return _grade(a, "exact", found == label, (found == label).cast("int"), F.concat(F.lit("extracted="), found, F.lit(" gold="), label), found)


def str_em(answers: DataFrame) -> DataFrame:
    """Every gold short answer appears in the output; the score is the share of sub-questions answered."""
    a = listed(answers, "str-em").where("size(qaPairs) > 0")
    said = F.array(X.normalize_answer(_text("output")))  # bound once for all short answers
    missing = F.flatten(F.transform(said, lambda o: F.filter("qaPairs", lambda p: ~F.coalesce(F.exists(p["shortAnswers"], lambda s: F.contains(o, X.normalize_answer(s))), F.lit(False)))))
    a = a.withColumn("__m", missing).withColumn("__n", F.size("qaPairs"))
    found = F.col("__n") - F.size("__m")
    names = F.array_join(F.transform("__m", lambda p: F.coalesce(F.get(p["shortAnswers"], 0), F.lit(""))), " | ")
    told = F.concat(_fraction(found, F.col("__n"), " sub-questions answered"), F.when(F.size("__m") > 0, F.concat(F.lit("; missing: "), names)).otherwise(F.lit("")))
    return _grade(a, "str-em", F.size("__m") == 0, ratio(found, F.col("__n")), told)


def _cited(answers: DataFrame) -> DataFrame:
    return answers.where("size(docs) > 0 and clauses is not null").withColumn("__cited", X.citations(_text("output"), F.size("docs")))


def clause_precision(answers: DataFrame) -> DataFrame:
    """Every cited passage contains the clause; for an absent clause nothing is cited."""
    a = _cited(listed(answers, "clause-precision")).withColumn("__gold", F.array_distinct(F.flatten(F.transform("clauses", lambda c: c["passages"]))))
    n = F.size("__cited")
    right = F.size(F.array_intersect("__cited", F.col("__gold").cast("array<bigint>")))
    absent = F.size("clauses") == 0
    passed = F.when(absent, n == 0).otherwise((n > 0) & (right == n))
    score = F.when(absent, (n == 0).cast("double")).when(n == 0, F.lit(0.0)).otherwise(ratio(right, n))
    told = F.when(absent & (n == 0) | ~absent & (n == 0), F.lit("nothing cited")).when(absent, F.concat(F.lit("cited "), X.cite_marks("__cited"), F.lit(" for an absent clause"))).otherwise(_fraction(right, n, " citations contain the clause"))
    return _grade(a, "clause-precision", passed, score, told)


def clause_recall(answers: DataFrame, judge: J.Judge | J.Memo = J.lexical) -> DataFrame:
    """Every clause is quoted (eight of its words in a row) and a passage of it is cited; an absent one is stated (judged)."""
    a = _cited(listed(answers, "clause-recall"))
    present = a.where("size(clauses) > 0")
    quoted = F.filter("clauses", lambda c: X.has_run(c["text"], _text("output"), QUOTE_WORDS))
    present = present.withColumn("__q", quoted)
    found = F.size(F.filter("__q", lambda c: F.arrays_overlap(c["passages"].cast("array<bigint>"), F.col("__cited"))))
    n = F.size("clauses")
    gold = F.array_join(F.transform("clauses", lambda c: X.cite_marks(c["passages"])), " ")
    cited = F.when(F.size("__cited") > 0, X.cite_marks("__cited")).otherwise(F.lit("nothing"))
    told = F.concat(_fraction(found, n, " clauses quoted and cited ("), F.size("__q").cast("string"), F.lit(" quoted); cited "), cited, F.lit(", gold "), gold)
    some = _grade(present, "clause-recall", found == n, ratio(found, n), told)
    kind = X.clause_type("input")
    none = F.lit(None).cast("array<bigint>")
    asked = a.where("size(clauses) = 0").select("ord", F.lit("absence").alias("kind"), "case_id", none.alias("refs"), kind.alias("claim"), _text("output").alias("premise"))
    stated = _memo(answers, judge).rule(asked, ["ord"])
    none = _grade(stated, "clause-recall", F.col("yes"), F.col("yes").cast("int"), F.when(F.col("yes"), "absence stated").otherwise("absence not stated"))
    return some.unionByName(none)


def cited_sentences(answers: DataFrame) -> DataFrame:
    """ord, case_id, s (place of the sentence), sentence, claim (without citations), refs: the sentences of every answer; the
    passages they cite stay with the case."""
    s = answers.where("size(docs) > 0").select("ord", "case_id", "graders", F.size("docs").alias("__n"), F.posexplode(X.sentences(_text("output"))).alias("s", "sentence"))
    return s.select("ord", "case_id", "s", "sentence", X.remove_citations("sentence").alias("claim"), X.citations("sentence", F.col("__n")).alias("refs"), "graders")


def _memo(answers: DataFrame, judge: J.Judge | J.Memo) -> J.Memo:
    """The memo itself, or one for this grader alone with the passages of the answers' cases."""
    if isinstance(judge, J.Memo):
        return judge
    return J.Memo(judge, answers.select("case_id", "docs").dropDuplicates(["case_id"]))


#: Graders that look at sentences and their citations.
CITING = ("citation-recall", "citation-precision", "citation-support")


def _sentences(answers: DataFrame, name: str, memo: J.Memo) -> DataFrame:
    """The sentences of the answers whose cases list a grader, from the memo if it has them."""
    s = memo.sentences if memo.sentences is not None else cited_sentences(listed(answers, name))
    return s.where(F.array_contains("graders", name)).select("ord", "case_id", "s", "claim", "refs")


def entailed(df: DataFrame, refs: Column) -> DataFrame:
    """Questions whether the claim of a row follows from the passages that refs name."""
    return df.withColumn("refs", refs).withColumn("kind", F.lit("entails")).withColumn("premise", F.lit(None).cast("string"))


def _scored(df: DataFrame, sentences: DataFrame, name: str, good: Column, told: Callable[[Column, Column, DataFrame], Column], none: str) -> DataFrame:
    each = sentences.groupBy("ord").agg(F.count("*").alias("n"), F.count_if(good).alias("ok"), F.count_if(F.size("refs") == 0).alias("uncited"))
    both = df.where("size(docs) > 0").select("ord").join(each, "ord", "left")
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("ok", F.lit(0))
    return _grade(both, name, (n > 0) & (ok == n), F.coalesce(ratio(ok, n), F.lit(0.0)), F.when(n == 0, F.lit(none)).otherwise(told(ok, n, both)))


def citation_recall(answers: DataFrame, judge: J.Judge | J.Memo = J.lexical) -> DataFrame:
    """Every sentence is supported by the passages it cites; one without citations is not supported."""
    a, memo = listed(answers, "citation-recall"), _memo(answers, judge)
    s = _sentences(answers, "citation-recall", memo)
    ruled = memo.rule(entailed(s.where(F.size("refs") > 0), F.col("refs")), ["ord", "s", "refs"])
    both = ruled.unionByName(s.where(F.size("refs") == 0).select("ord", "s", "refs", F.lit(False).alias("yes")))
    return _scored(a, both, "citation-recall", F.col("yes"), lambda ok, n, _: F.concat(_fraction(ok, n, " sentences supported, "), F.col("uncited").cast("string"), F.lit(" without citation")), "no sentences")


def citation_precision(answers: DataFrame, judge: J.Judge | J.Memo = J.lexical) -> DataFrame:
    """Every citation is necessary: its passage alone supports the sentence, or the others don't without it.

    Asked in phases, each deduplicated: the sentence with all its passages; where that holds and there are several, each
    passage alone; where that fails, the passages without it.
    """
    a, memo = listed(answers, "citation-precision"), _memo(answers, judge)
    s = _sentences(answers, "citation-precision", memo).where(F.size("refs") > 0)
    held = memo.rule(entailed(s, F.col("refs")), ["ord", "s", "case_id", "claim", "refs"]).withColumnRenamed("yes", "whole")
    one = held.where(F.col("whole") & (F.size("refs") > 1)).select("ord", "s", "case_id", "claim", F.col("refs").alias("all"), F.explode("refs").alias("ref"))
    alone = memo.rule(entailed(one, F.array("ref")), ["ord", "s", "case_id", "claim", "all", "ref"]).withColumnRenamed("yes", "alone")
    rest = memo.rule(entailed(alone.where(~F.col("alone")), F.array_remove("all", F.col("ref"))), ["ord", "s"])
    needed = alone.where("alone").select("ord", "s").unionByName(rest.where(~F.col("yes")).select("ord", "s")).groupBy("ord", "s").agg(F.count("*").alias("needed"))
    each = held.select("ord", "s", F.size("refs").alias("k"), "whole").join(needed, ["ord", "s"], "left")
    precise = F.when(~F.col("whole"), 0).when(F.col("k") == 1, 1).otherwise(F.coalesce("needed", F.lit(0)))
    sums = each.groupBy("ord").agg(F.sum("k").alias("total"), F.sum(precise).alias("precise"))
    both = a.where("size(docs) > 0").select("ord").join(sums, "ord", "left")
    total, good = F.coalesce("total", F.lit(0)), F.coalesce("precise", F.lit(0))
    return _grade(both, "citation-precision", (total > 0) & (good == total), F.coalesce(ratio(good, total), F.lit(0.0)), _fraction(good, total, " citations necessary"))


def citation_support(answers: DataFrame, judge: J.Judge | J.Memo = J.lexical) -> DataFrame:
    """Every sentence of three words or more is supported by what it cites or, uncited, speaks of the documents."""
    a, memo = listed(answers, "citation-support"), _memo(answers, judge)
    s = _sentences(answers, "citation-support", memo).where(F.size(F.split("claim", " ")) >= MIN_WORDS)
    kind = F.when(F.size("refs") > 0, "entails").otherwise("about")
    ruled = memo.rule(s.withColumn("kind", kind).withColumn("premise", F.lit(None).cast("string")), ["ord", "s", "refs"])
    return _scored(a, ruled, "citation-support", F.col("yes"), lambda ok, n, _: _fraction(ok, n, " sentences supported or about the documents"), "no sentence")


def _spans(answers: DataFrame, name: str, text: Column, what: str, measurable: Column | None = None) -> DataFrame:
    a = listed(answers, name).where("size(protected) > 0").withColumn("__text", text)
    a = a.withColumn("__bad", F.filter("protected", lambda s: X.contains_span(F.col("__text"), s)))
    n, bad = F.size("protected"), F.size("__bad")
    told = F.concat(_fraction(bad, n, f" {what}"), F.when(bad > 0, F.concat(F.lit(": "), F.array_join("__bad", " | "))).otherwise(F.lit("")))
    ok = F.lit(True) if measurable is None else measurable
    null = F.lit(None)
    return _grade(a, name, F.when(ok, bad == 0).otherwise(null), F.when(ok, 1 - ratio(bad, n)).otherwise(null), F.when(ok, told).otherwise(F.lit("not measurable: the requests were not kept")))


def removal(answers: DataFrame) -> DataFrame:
    """No protected span survives in the output."""
    return _spans(answers, "removal", _text("output"), "protected spans survived")


def leakage(answers: DataFrame) -> DataFrame:
    """No protected span reached the model. Where the requests were not kept the grade is NULL, not passed."""
    return _spans(answers, "leakage", F.array_join(F.coalesce("model_requests", F.array().cast("array<string>")), "\n"), "reached the model", F.col("model_requests").isNotNull())


def retention(answers: DataFrame) -> DataFrame:
    """At least 90 % of the tokens that are not protected survive, counted as often as they occur."""
    a = listed(answers, "retention").where("size(protected) > 0")
    want = a.select("ord", F.explode(X.tokens(X.remove_spans(_text("input"), "protected"))).alias("t")).groupBy("ord", "t").agg(F.count("*").alias("w"))
    have = a.select("ord", F.explode(X.tokens(_text("output"))).alias("t")).groupBy("ord", "t").agg(F.count("*").alias("h"))
    kept = want.join(have, ["ord", "t"], "left").groupBy("ord").agg(F.sum("w").alias("n"), F.sum(F.least("w", F.coalesce("h", F.lit(0)))).alias("k"))
    both = a.select("ord").join(kept, "ord", "left")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    score = F.coalesce(ratio(k, n), F.lit(1.0))
    return _grade(both, "retention", score >= RETAINED, score, _fraction(k, n, " non-protected tokens kept"))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "exact": exact, "str-em": str_em, "citation-recall": citation_recall, "citation-precision": citation_precision, "clause-recall": clause_recall,
    "clause-precision": clause_precision, "citation-support": citation_support, "removal": removal, "leakage": leakage, "retention": retention,
}


def gold_problems(private: DataFrame, known: list[str] | None = None, public: DataFrame | None = None) -> DataFrame:
    """id, grader, problem: cases whose gold doesn't fit a grader they list, before anything costly runs. With the public
    halves also cases without the choices or passages that a grader looks at."""
    if public is not None:
        private = private.join(public.select("id", F.coalesce(F.size("choices"), F.lit(-1)).alias("__choices"), F.coalesce(F.size("docs"), F.lit(-1)).alias("__docs"), F.lit(True).alias("__there")), "id", "left")
    flat = private.withColumn("grader", F.explode_outer("graders"))
    there = public is not None
    lacks = lambda c: (F.coalesce("__there", F.lit(False)) & (F.col(c) < 1)) if there else F.lit(False)
    g = F.col("grader")
    clause = g.isin("clause-recall", "clause-precision", "citation-support")
    redact = g.isin("removal", "leakage", "retention")
    problem = (
        F.when(g.isNull(), "no graders")
        .when(~g.isin(known or list(REGISTRY)), "unknown grader")
        .when((g == "exact") & F.col("answer").isNull(), "needs an answer")
        .when((g == "str-em") & (F.coalesce(F.size("qaPairs"), F.lit(-1)) < 1), "needs qaPairs")
        .when(clause & F.col("clauses").isNull(), "needs clauses")
        .when(redact & (F.coalesce(F.size("protected"), F.lit(-1)) < 1), "needs protected spans")
        .when(redact & F.coalesce(F.exists("protected", lambda s: X.strip(s) == ""), F.lit(False)), "empty protected span")
        .when((g == "exact") & lacks("__choices"), "needs choices")
        .when((clause | g.isin("citation-recall", "citation-precision")) & lacks("__docs"), "needs docs")
    )
    return flat.select("id", "grader", problem.alias("problem")).where("problem is not null")


def dispatch(answers: DataFrame, registry: dict[str, Callable[..., DataFrame]] | None = None, judge: J.Judge | J.Memo = J.lexical) -> DataFrame:
    """ord, place, grader, pass, score, extracted, detail, status: for every record the grades that its case lists, in order.

    A record with a run error fails every grade (run_error); a grade that can't be made fails (grade_error), also for a
    grader that nobody knows; a grade that is not measurable stays NULL. A registered grader is a function of answers, or of
    answers and a judge: these share one memo, so recall after precision asks nothing again, and one table of sentences.
    """
    registry = registry or REGISTRY
    ran = answers.where("error is null or error = ''")
    memo = _memo(ran, judge)
    if memo.sentences is None and not set(CITING).isdisjoint(registry):
        citing = ran.where(F.arrays_overlap("graders", F.array(*map(F.lit, CITING))))
        memo.sentences = cut_lineage(cited_sentences(citing).drop("sentence").withColumn("graders", F.array_intersect("graders", F.array(*map(F.lit, CITING)))))
    made = None
    for grade in registry.values():
        part = grade(ran, memo) if "judge" in signature(grade).parameters else grade(ran)
        made = part if made is None else made.unionByName(part)
    grid = answers.select("ord", "error", F.posexplode("graders").alias("place", "grader"))
    both = grid.join(made.withColumn("made", F.lit(True)), ["ord", "grader"], "left")
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    lost = failed | F.col("made").isNull()
    status = F.when(failed, "run_error").when(F.col("made").isNull(), "grade_error").otherwise("ok")
    return both.select(
        "ord", "place", "grader", F.when(lost, F.lit(False)).otherwise(F.col("pass")).alias("pass"), F.when(lost, F.lit(0.0)).otherwise(F.col("score")).alias("score"), "extracted",
        F.when(failed, F.concat(F.lit("run error: "), "error")).when(lost, F.lit("could not be graded")).otherwise(F.col("detail")).alias("detail"), status.alias("status"),
    )
