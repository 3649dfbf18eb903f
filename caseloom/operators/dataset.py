"""Building benchmark cases from raw corpora: chunking, span alignment, balanced selection, seeded order, case pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import SHUFFLE_SEED, permutation
from ..functions.text import WS, cite_marks, collapse, format_docs, padded_id, word_count
from .order import numbered

PASSAGE_WORDS = 200
# fixed values: the default clause types and the hard ones; their order breaks ties
DEFAULT_TYPES = (
    "Governing Law", "Anti-Assignment", "License Grant", "Cap On Liability", "Termination For Convenience", "Renewal Term", "Revenue/Profit Sharing", "Exclusivity",
    "Audit Rights", "Post-Termination Services", "Minimum Commitment", "Non-Compete",
)
HARD_TYPES = ("Change Of Control", "Ip Ownership Assignment", "Most Favored Nation", "Non-Disparagement", "Covenant Not To Sue", "Liquidated Damages", "Uncapped Liability")
#: Of every ten cases those at these places ask for something that isn't there.
ABSENT_AT = (2, 5, 8)


def passage_bounds(text: Column | str, words: int = PASSAGE_WORDS) -> Column:
    """Passages of about `words` words as array<struct<start, end>> (0-based, in characters).

    A passage ends at the first sentence end (marks followed by white space) where it has that many words; the rest is the
    last passage. An empty text has none, NULL gives NULL.
    """
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(?:.*?[.!?]+{WS}+|.+\z)"), F.lit(0))
    # every piece but perhaps the last ends a sentence, and whether a passage ends with the last makes no difference
    # lengths and words are worked out once: an expression inside a fold is repeated wherever its value is used
    pieces = F.transform(pieces, lambda p: F.struct(F.length(p).alias("len"), word_count(p).alias("words")))
    state = F.struct(F.lit(0).alias("start"), F.lit(0).alias("at"), F.lit(0).alias("words"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        at = s["at"] + p["len"]
        n = s["words"] + p["words"]
        cut = n >= words
        here = F.array(F.struct(s["start"].alias("start"), at.alias("end")))
        return F.struct(F.when(cut, at).otherwise(s["start"]).alias("start"), at.alias("at"), F.when(cut, 0).otherwise(n).alias("words"), F.when(cut, F.concat(s["out"], here)).otherwise(s["out"]).alias("out"))

    def finish(s: Column) -> Column:
        rest = F.array(F.struct(s["start"].alias("start"), s["at"].alias("end")))
        return F.when(s["start"] < s["at"], F.concat(s["out"], rest)).otherwise(s["out"])

    return F.aggregate(pieces, state, step, finish)


def chunk(df: DataFrame, key: str, text: str, words: int = PASSAGE_WORDS) -> DataFrame:
    """key, part, parts, start, end, passage (white space collapsed): the passages of every text, parts from 1."""
    bounds = df.select(key, F.col(text).alias("__text"), passage_bounds(text, words).alias("__b"))
    flat = bounds.select(key, "__text", F.size("__b").alias("parts"), F.posexplode("__b").alias("p", "b"))
    cut = F.expr("substring(__text, b.start + 1, b.end - b.start)")
    return flat.select(key, (F.col("p") + 1).alias("part"), "parts", F.col("b.start").alias("start"), F.col("b.end").alias("end"), collapse(cut).alias("passage"))


def overlapping(bounds: Column, start: Column, end: Column) -> Column:
    """0-based passages that share a character with [start, end)."""
    hit = F.transform(bounds, lambda b, i: F.when((b["start"] < end) & (start < b["end"]), i))
    return F.filter(hit, lambda i: i.isNotNull())


def span_overlap(spans: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """Spans (key, s, e) with the parts they overlap: a range join within each key."""
    on = (F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))
    return spans.join(passages.select(key, "part", "start", "end"), key).where(on).select(key, "s", "e", "part")


def round_robin(rows: DataFrame, group: str, label: str, order: str, count: int) -> DataFrame:
    """Within each group, `count` rows picked in turn from its labels: the labels in order of first appearance, each label's
    rows in order; fewer if the group has fewer. Adds `pick` (from 1)."""
    nth = F.row_number().over(Window.partitionBy(group, label).orderBy(order))
    first = F.min(order).over(Window.partitionBy(group, label))
    placed = rows.withColumn("__nth", nth).withColumn("__first", first).where(F.col("__nth") <= count)
    pick = F.row_number().over(Window.partitionBy(group).orderBy("__nth", "__first", order))
    return placed.withColumn("pick", pick).where(F.col("pick") <= count).drop("__nth", "__first")


def greedy_balance(contracts: DataFrame, types: Sequence[str], prefer_multi: bool = False, absent_at: Sequence[int] = ABSENT_AT, skip: int = 0) -> DataFrame:
    """i, contract, category, absent: contracts in the order of `place`, each with the fitting type used least so far.

    contracts: contract, place, qas array<struct<category:string, n_answers:int>>. At the places of absent_at in every ten a
    type without answers is asked for, else one with answers; ties go to the earlier type. A contract that fits nothing is
    skipped and takes no number. prefer_multi: types with several answers win where the contract has one. skip: so many of the
    first numbers are chosen but not given out, so a set can be continued. The choice depends on all before it, so one task
    makes it; it sees categories and counts only, in sorted batches, and holds nothing but the counts per type.
    """
    rank = {t: i for i, t in enumerate(types)}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, made = dict.fromkeys(types, 0), 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                absent = made % 10 in absent_at
                fit = [q for q in r["qas"] or [] if q and q["category"] in rank and (q["n_answers"] == 0) == absent]
                several = [q for q in fit if q["n_answers"] > 1]
                if prefer_multi and several:
                    fit = several
                if fit:
                    best = min(fit, key=lambda q: (used[q["category"]], rank[q["category"]]))["category"]
                    used[best] += 1
                    if made >= skip:
                        out.append((made, r["contract"], best, absent))
                    made += 1
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.string(), pa.bool_()))], ["i", "contract", "category", "absent"])

    small = contracts.select("contract", "place", "qas").coalesce(1).sortWithinPartitions("place", "contract")
    return small.mapInArrow(choose, "i int, contract string, category string, absent boolean")


def seeded_order(items: DataFrame, key: str, order: Sequence[str], seed: int = SHUFFLE_SEED) -> DataFrame:
    """items with `place`: their place after a seeded shuffle of them in the given order.

    The items are numbered range by range and joined with the permutation. Its draws depend on all before them, so one task
    makes it, over indexes only (eight bytes an item), and gives it out in batches.
    """
    n = items.count()

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                shuffled = permutation(n, seed)
                for at in range(0, n, 100_000):
                    some = shuffled[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(range(at, at + len(some)), pa.int32())], ["__i", "place"])

    places = items.sparkSession.range(1, numPartitions=1).mapInArrow(permute, "__i bigint, place int")
    places_of = numbered(items.select(key, *[c for c in order if c != key]), order, "__n").select(key, (F.col("__n") - 1).alias("__i")).join(places.hint("merge"), "__i").drop("__i")
    return items.join(places_of, key)


def page(rows: DataFrame, place: str, offset: int, count: int) -> DataFrame:
    """The rows at the places offset to offset + count - 1 (from 0): a filter, nothing is sorted."""
    return rows.where(F.col(place).between(offset, offset + count - 1))


def exactly(rows: DataFrame, place: str, count: int) -> DataFrame:
    """The first `count` rows by place (from 0, without gaps); an error if there are fewer."""
    chosen = page(rows, place, 0, count)
    n = chosen.count()
    if n != count:
        raise ValueError(f"{n} rows instead of {count}")
    return chosen


def shortest_first(contracts: DataFrame, key: str, text: str, wanted: Column) -> DataFrame:
    """The shortest contract for which `wanted` holds, ties by key: one row or none."""
    return contracts.where(wanted).orderBy(F.length(text), key).limit(1)


def in_length_window(text: Column | str, low: int, high: int) -> Column:
    """Whether a text has low to high parts between white space, both included."""
    return F.size(F.split(F.col(text) if isinstance(text, str) else text, rf"{WS}+")).between(low, high)


def demo_answer(clauses: Column, kind: str | None = None) -> Column:
    """A worked answer from the gold clauses: each quoted with its passages, or the statement that there is none."""
    what = f'"{kind}" clause' if kind else "clause"
    quoted = F.transform(clauses, lambda c: F.concat(F.lit('"'), c["text"], F.lit('" '), cite_marks(c["passages"])))
    told = F.concat(F.lit(f"The contract has {'a' if kind else 'the'} {what}, which reads: "), F.array_join(quoted, " and also: "), F.lit("."))
    return F.when(F.size(clauses) == 0, F.lit(f"The contract has no {what if kind else 'such clause'}.")).otherwise(told)


def case_pairs(rows: DataFrame, suite: str, task: str, instructions: str, graders: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Public and private cases from rows (i, question, docs, clauses, source): what a system sees, and the gold."""
    numbered = rows.withColumn("id", padded_id(F.lit(suite), F.col("i")))
    prompt = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\n"), format_docs(F.col("docs")))
    public = numbered.select("id", F.lit(suite).alias("suite"), F.lit(task).alias("task"), F.lit(instructions).alias("instructions"), prompt.alias("input"), "docs", F.col("source").alias("_source"))
    private = numbered.select("id", F.array(*[F.lit(g) for g in graders]).alias("graders"), "clauses")
    return public, private


def label_cases(rows: DataFrame, template: DataFrame, existing: DataFrame) -> DataFrame:
    """New label cases: rows (task, idx, text, answer) whose id isn't there yet, with the fields of the task's first case."""
    first = template.groupBy("task").agg(F.min_by(F.struct("suite", "instructions", "examples", "question", "choices"), "id").alias("t"))
    made = rows.withColumn("id", padded_id(F.col("task"), F.col("idx"))).join(existing.select("id"), "id", "left_anti")
    return made.join(first, "task").select("id", "task", "t.*", F.trim("text").alias("input"), "answer")
