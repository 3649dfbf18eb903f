"""Judging: yes/no questions to a model, each distinct question asked once.

A judge takes rows of distinct questions (prompt, kind, premise, claim) and adds `reply`. A real model is a judge made by
`model_judge` from a function of prompts; the lexical stand-in is deterministic and stays in the JVM. A `Memo` holds the
verdicts of a run, so graders that ask the same share one answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_words, passages_text, says_yes, tokens
from ..plans.session import cut_lineage

Judge = Callable[[DataFrame], DataFrame]

#: Share of a claim's words that its premise must have for the lexical judge.
LEXICAL = 0.6
#: Questions that are open at once over the whole run, in at most so many tasks.
IN_FLIGHT, TASKS = 64, 8


def entails_prompt(premise: Column, claim: Column) -> Column:
    return F.concat(F.lit("Text:\n"), premise, F.lit("\n\nClaim: "), claim, F.lit("\n\nDoes the claim follow from the text, with all its facts? One word, yes or no:"))


def about_prompt(claim: Column) -> Column:
    return F.concat(F.lit("Claim: "), claim, F.lit("\n\nDoes this speak only of what the documents hold or lack, with no fact from them? One word, yes or no:"))


def absence_prompt(output: Column, kind: Column) -> Column:
    return F.concat(F.lit("Answer:\n"), output, F.lit('\n\nDoes it say that there is no "'), kind, F.lit('" clause? One word, yes or no:'))


def lexical(questions: DataFrame) -> DataFrame:
    """A stand-in: a claim follows if its premise has most of its distinct words; it is about the documents, or states an
    absence, if it has a word of denial beside one of the contract, document, passage or clause."""
    words = F.array_distinct(tokens("claim"))
    share = F.size(F.array_intersect(words, tokens("premise"))) / F.greatest(F.size(words), F.lit(1))
    said = F.when(F.col("kind") == "absence", F.col("premise")).otherwise(F.col("claim"))
    plain = F.concat(F.lit(" "), normalize_words(said), F.lit(" "))
    denial = plain.rlike(" (no|not|none|nothing|neither|without|absent) ") & plain.rlike(" (clauses?|contract|documents?|passages?) ")
    yes = F.when(F.col("kind") == "entails", share >= LEXICAL).otherwise(denial)
    return questions.withColumn("reply", F.when(yes, "yes").otherwise("no"))


def model_judge(ask: Callable[[str], str], in_flight: int = IN_FLIGHT, retries: int = 3, pause: float = 0.5) -> Judge:
    """A judge from a function prompt -> reply: at most `in_flight` questions at once over all tasks, each asked again after
    a failure (after `pause` seconds, then twice as long each time), and NULL (no verdict) when all attempts fail."""
    tasks = max(1, min(TASKS, in_flight))

    def one(prompt: str) -> str | None:
        for k in range(retries + 1):
            try:
                return ask(prompt)
            except Exception:
                if k < retries:
                    time.sleep(pause * 2**k)
        return None

    def judge(questions: DataFrame) -> DataFrame:
        columns = questions.columns

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(in_flight // tasks) as pool:
                for f in frames:
                    yield f.assign(reply=list(pool.map(one, f["prompt"])))[[*columns, "reply"]]

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema.fields)
        return questions.repartition(tasks).mapInPandas(run, f"{ddl}, reply string")

    return judge


class Memo:
    """The verdicts of a run: every distinct question is put to the judge once, whichever grader asks it and however often.

    passages: case_id, docs of the cases asked about, one row each. limit: the most questions put to the judge, those with the
    least digests; what lies beyond has no verdict, which is no yes. `asked` has a row per question put: kind, tokens_in,
    tokens_out (words) and whether there was a reply.
    """

    def __init__(self, judge: Judge = lexical, passages: DataFrame | None = None, limit: int | None = None):
        self.judge, self.passages, self.limit = judge, passages, limit
        self.verdicts: DataFrame | None = None
        self.asked: DataFrame | None = None
        self.sentences: DataFrame | None = None
        self._count = 0
        self._first: DataFrame | None = None

    def rule(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """The columns `keep` of every row (kind, case_id, refs, claim, premise) with `yes`.

        The premise of a question of kind entails is made of the passages `refs` of its case; only distinct questions meet
        the passages, rows carry a digest.
        """
        refs = F.array_join(F.col("refs").cast("array<string>"), ",")
        parts = [F.col("kind"), F.when(F.col("kind") == "entails", F.col("case_id")), F.when(F.col("kind") == "entails", refs), F.col("claim"), F.col("premise")]
        keyed = rows.withColumn("__q", F.md5(F.concat_ws("\0", *[F.coalesce(p, F.lit("\1")) for p in parts])))
        new = keyed.select("__q", "kind", parts[1].alias("case_id"), parts[2].alias("refs"), "claim", "premise").distinct()
        if self.verdicts is not None:
            new = new.join(self.verdicts.select("__q"), "__q", "left_anti")
        if self.passages is not None:
            told = passages_text(F.col("docs"), F.when(F.col("refs") != "", F.split("refs", ",").cast("array<bigint>")).otherwise(F.array().cast("array<bigint>")))
            new = new.join(self.passages, "case_id", "left").withColumn("premise", F.when(F.col("kind") == "entails", told).otherwise(F.col("premise")))
        if self.judge is lexical:
            found = self.judge(new).select("__q", "reply")
        else:
            if "ord" in rows.columns:
                first = keyed.join(new.select("__q"), "__q", "left_semi").groupBy("__q").agg(F.min("ord").alias("ord"))
                self._first = first if self._first is None else self._first.unionByName(first)
            found = self._put(new)
        found = cut_lineage(found.select("__q", F.coalesce(says_yes("reply"), F.lit(False)).alias("yes")))
        self.verdicts = found if self.verdicts is None else self.verdicts.unionByName(found)
        return keyed.join(self.verdicts, "__q").select(*keep, "yes")

    def _put(self, new: DataFrame) -> DataFrame:
        """The replies to new questions; those with the same prompt are one, none is put again when a task is repeated."""
        prompt = F.when(F.col("kind") == "entails", entails_prompt(F.col("premise"), F.col("claim"))).when(F.col("kind") == "about", about_prompt(F.col("claim"))).otherwise(absence_prompt(F.col("premise"), F.col("claim")))
        asked = cut_lineage(new.select("__q", "kind", "premise", "claim", prompt.alias("prompt")).withColumn("__key", F.sha2("prompt", 256)))
        once = asked.dropDuplicates(["__key"])
        if self.limit is not None:
            once = once.orderBy("__key").limit(max(0, self.limit - self._count))
        replies = cut_lineage(self.judge(once.select("__key", "prompt", "kind", "premise", "claim")).select("__key", "kind", F.size(F.split("prompt", r"\s+")).alias("tokens_in"), "reply"))
        if self.limit is not None:
            self._count += replies.count()
        told = asked.select("__q", "__key").join(replies, "__key").groupBy("__key").agg(F.min("__q").alias("__q"), *[F.first(c).alias(c) for c in ("kind", "tokens_in", "reply")]).select("__q", "kind", "tokens_in", F.coalesce(F.size(F.split("reply", r"\s+")), F.lit(0)).alias("tokens_out"), F.col("reply").isNotNull().alias("replied"))
        self.asked = told if self.asked is None else self.asked.unionByName(told)
        return asked.select("__q", "__key").join(replies.select("__key", "reply"), "__key", "left").select("__q", "reply")

    def used_by_record(self) -> DataFrame | None:
        """ord, modelCalls, tokensIn, tokensOut: the questions put, counted at the record that asked first; None if the judge is
        no model."""
        if self.asked is None or self._first is None:
            return None
        return self.asked.join(self._first, "__q").groupBy("ord").agg(F.count("*").alias("modelCalls"), F.sum("tokens_in").alias("tokensIn"), F.sum("tokens_out").cast("bigint").alias("tokensOut"))

    def usage(self) -> DataFrame | None:
        """modelCalls, tokensIn, tokensOut, failed of all questions put so far; None if the judge is no model."""
        if self.asked is None:
            return None
        return self.asked.agg(F.count("*").alias("modelCalls"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokensIn"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokensOut"), F.count_if(~F.col("replied")).alias("failed"))


def ruled(asked: DataFrame, judge: Judge, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row of `asked` (prompt, kind, premise, claim) with `yes`, its verdict: each distinct
    question is put once, and only its digest is shuffled with the rows. A reply that is missing is no yes."""
    keyed = asked.withColumn("__key", F.sha2("prompt", 256))
    once = keyed.select("__key", "prompt", "kind", "premise", "claim").dropDuplicates(["__key"])
    replies = judge(once).select("__key", "reply")
    if judge is not lexical:
        replies = cut_lineage(replies)  # a model isn't asked again when a task or a plan is repeated
    both = keyed.select(*keep, "__key").join(replies, "__key")
    return both.select(*keep, F.coalesce(says_yes("reply"), F.lit(False)).alias("yes"))
