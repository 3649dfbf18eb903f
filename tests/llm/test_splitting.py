"""Pieces: limits, cover, overlap, natural boundaries, forced cuts only where there is no other way."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm.splitting import split_oversized, split_text


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e, _ in pieces) or text == ""
    for (s, e, _), (s2, e2, _) in zip(pieces, pieces[1:]):
        assert s < s2 <= e < e2 and e - s2 <= overlap
    forced = any(k == "forced" for *_, k in pieces)
    assert forced == (max(len(x) for x in re.split(r"\s|(?<=[。！？])", text)) > limit)
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word ", "longerword ", "End. ", "a;\n", "\n\n", "x" * 37, "x" * 40, "x" * 41, "é。", " ", "x" * 90, "  \t"]), max_size=60))
def test_any_text(parts):
    check("".join(parts), 40, 8)


def test_boundaries_are_the_strongest_near():
    text = "\n\n".join("One sentence here. Another one there; it goes on." for _ in range(12))
    assert {k for *_, k in check(text, 200, 20)} <= {"paragraph", "end"}
    prose = " ".join(f"Sentence number {i} ends." for i in range(60))
    assert {k for *_, k in check(prose, 200, 20)} <= {"sentence", "end"}
    pieces = check(prose, 200, 20)
    assert all(e - s2 == 20 for (s, e, _), (s2, *_) in zip(pieces, pieces[1:]))
    sizes = [e - s for s, e, _ in pieces]
    assert max(sizes) - min(sizes) < 80  # balanced


def test_bounds():
    assert split_text("", 10, 2) == [(0, 0, "end")] and split_text("x" * 10, 10, 2) == [(0, 10, "end")]
    with pytest.raises(ValueError):
        split_text("abc", 10, 10)
    check("x" * 100_000, 2000, 200)
    check("word " * 100_000, 2000, 200)


def test_operator(spark):
    long = "Some words here. " * 200
    df = spark.createDataFrame([("a", 1, long, "z"), ("a", 2, "short", "z"), ("b", 1, None, "z"), ("c", 1, "", "z"), ("d", 1, "x" * 2001, "z"), ("e", 1, "😀" * 2001, "z"), ("a", 1, long, "z")], "case_id string, passage int, text string, piece string")
    out = split_oversized(df, "text", ["case_id", "passage"])
    rows = out.orderBy("case_id", "piece").collect()
    assert {r.case_id for r in rows} == {"a", "d", "e"}
    for r in rows:
        text = long if r.case_id == "a" else {"d": "x", "e": "😀"}[r.case_id] * 2001
        assert r.piece_text == text[r.start : r.end] and len(r.piece_text) <= 2000
    assert len([r for r in rows if r.case_id == "a" and r.piece == 1]) == 2
    assert split_oversized(df.where("false"), "text", ["case_id"]).count() == 0


def test_scripts_without_white_space_are_cut_at_their_stops():
    text = "该条款将金额限制在每年以内并要求双方遵守。" * 300
    pieces = split_text(text)
    assert {k for _, _, k in pieces} == {"sentence", "end"} and all(text[e - 1] == "。" for _, e, _ in pieces) and max(e - s for s, e, _ in pieces) <= 2000


def test_as_many_pieces_as_a_plan_needs():
    # boundaries in every window: a plan is always found, whatever the number of pieces beyond the fewest
    r = random.Random(5)
    for n in (5_000, 40_000):
        text = " ".join("x" * r.randint(300, 450) for _ in range(n // 400))
        pieces = split_text(text)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(b[0] == a[1] - 200 for a, b in zip(pieces, pieces[1:])) and "forced" not in {k for _, _, k in pieces}
