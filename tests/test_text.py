"""Text functions on the cases that engines disagree on."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.functions.numbers import grade_cell, half_up, lcg_states, permutation, points


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("out", "want"),
    [("Yes.", "yes"), ("**Yes**\nNo or yes?", "yes"), ("I think no.", "no"), ("yes or no", None), ("café no", "no"), ("nothing", None), ("", None), (None, None)],
)
def test_extract_choice(spark, out, want):
    assert one(spark, X.extract_choice("o", "c"), o=out, c=["Yes", "No"]) == want


def test_labels_listed_twice_are_never_the_only_one(spark):
    assert one(spark, X.extract_choice("o", "c"), o="it is no, I say", c=["No", "no"]) is None


def test_sentences_and_citations(spark):
    s = "First one [1]. Second is 4.4 long! (Third) see [2, 9][12] \"quoted\"? Yes."
    assert one(spark, X.sentences("s"), s=s) == ["First one [1].", "Second is 4.4 long!", "(Third) see [2, 9][12] \"quoted\"?", "Yes."]
    assert one(spark, X.citations("s", F.lit(9)), s="a [2, 3] b [2] [1 [0] [99999999999999999999] [10]") == [1, 0]
    assert one(spark, X.citations_closed("s", F.lit(9)), s="[2, 3] [4] [4] [1") == [3]
    assert one(spark, X.remove_citations("s"), s=" a  [1][2] b [1, 2] ") == "a b [1, 2]"
    assert one(spark, X.sentences("s"), s="") == [] and one(spark, X.sentences("s"), s=None) is None


def test_normal_forms(spark):
    assert one(spark, X.normalize_words("s"), s=" Éa b—c_d  9 ") == "éa bcd 9"
    assert one(spark, X.normalize_answer("s"), s="The cat, an Owl & a_theme the") == "cat owl atheme"
    assert one(spark, X.normalize_label("s"), s=' "Yes ."*') == "yes "
    assert one(spark, X.collapse("s"), s=" a \n b﻿") == "a b"


@pytest.mark.parametrize(
    ("text", "span", "want"),
    [("Call ANNA  Smith!", "anna smith", True), ("Annabel", "anna", False), ("x9.5y", "9.5", False), ("a (b) c", "(b)", True), ("abc", " ", False), ("été", "ÉTÉ", True), (r"a\Eb", r"\E", False), (r"a \E b", r"\E", True)],
)
def test_contains_span(spark, text, span, want):
    assert one(spark, X.contains_span("t", "s"), t=text, s=span) is want


def test_longest_run(spark):
    def brute(claim, text):
        w = claim.split(" ")
        return max(n for a in range(len(w)) for n in range(0, len(w) - a + 1) if " ".join(w[a : a + n]) in text)

    for claim, text in [("a b c d", "x b c y"), ("one two three", "three two one"), ("", "abc"), ("the cat sat", "athe cat saturday"), ("zz", "")]:
        got = one(spark, X.longest_run("c", "t"), c=claim, t=text)
        assert got == (1 if claim == "" else brute(claim, text)), (claim, text)
    assert one(spark, X.longest_run("c", "t"), c=None, t="x") is None
    assert one(spark, X.has_run("c", "t", 3), c="q a b c z", t="xa b cx") is True and one(spark, X.has_run("c", "t", 3), c="a b", t="a b") is False


def test_scrub(spark):
    s = "a.b@c.example.org, +1 555 010 0199; 10.0.0.1 x 2001:db8:1:2:3:4:5:6"
    assert one(spark, X.scrub("s"), s=s) == "[REDACTED], [REDACTED]; [REDACTED] x [REDACTED]"
    assert [f.split(":")[0] for f in one(spark, X.scrub_findings("s"), s=s)] == ["email", "phone", "ipv4", "ipv6"]
    assert one(spark, X.scrub_items("s", "i"), s="Ann  Lee, ann lee.", i=["Ann Lee", " ", "$1"]) == "[REDACTED], [REDACTED]."
    assert one(spark, X.remove_spans("s", "i"), s="abab c", i=["ab", ""]) == "   c"


def test_parsers(spark):
    assert one(spark, X.bracketed_list("s"), s='Sure: ["Ann", "x", 3, "Ann"] ok') == ["Ann"]
    assert one(spark, X.bracketed_list("s"), s="none") == []
    assert one(spark, X.bare_lines("s"), s='- "a b"\n\n[2] c\nNone\n3) d') == ["a b", "c", "d"]
    assert [(q.passage, q.text) for q in one(spark, X.quote_lines("s"), s=' [3] "x y" \nno\n[1]z')] == [(2, "x y"), (0, "z")]
    assert one(spark, X.insert_citations("s", F.lit("[1]")), s="Done?!") == "Done [1]?!"
    assert one(spark, X.padded_id(F.lit("s"), "n"), n=7) == "s-007" and one(spark, X.padded_id(F.lit("s"), "n"), n=1234) == "s-1234"
    assert one(spark, X.verdict_word("s"), s="**Yes**, but no") == "yes" and one(spark, X.verdict_word("s"), s="knows") == "no"


def test_numbers(spark):
    state, want = 20260830, []
    for _ in range(300):
        state = (state * 1664525 + 1013904223) % 2**32
        want.append(state)
    assert lcg_states(300).tolist() == want
    assert sorted(permutation(50)) == list(range(50)) and permutation(50) == permutation(50) and list(permutation(0)) == [] and list(permutation(1)) == [0]
    row = spark.range(1).select(half_up(F.lit(-2.5)).alias("a"), half_up(F.lit(2.5)).alias("b"), points(F.lit(-0.126)).alias("c"), grade_cell(F.lit(0.5), F.lit(0.75)).alias("d"), grade_cell(F.lit(0.5), F.lit(0.5)).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (-2, 3, "−13", "50% (avg 75%)", "50%")
