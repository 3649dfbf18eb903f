"""Shared spans against brute force, for every way a digest can take."""

import random

import numpy as np
import pytest

from caseloom.llm import spans as S


def longest_common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
        best = max(best, max(new))
        row = new
    return best


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß漢") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    stock, span, exact = prose(12)[:90], prose(80)[:260], prose(80)[:120]
    texts = {"empty": "", "null": None, "short": "abc", "same1": prose(60), "periodic": "ab" * 400, "periodic2": "x" + "ab" * 300, "const": "z" * 500}
    texts["same2"] = texts["same1"]
    for i in range(12):
        texts[f"stock{i}"] = prose(20) + stock + prose(20)
    for i, n in enumerate((117, 118, 119)):  # and the two characters before
        texts[f"edge{i}"] = prose(30) + " |" + exact[:n] + "| " + prose(10)
    for i in range(4):
        texts[f"span{i}"] = prose(15 + i) + span + prose(10)
    return texts


@pytest.mark.parametrize("hot", [1, 3, 100])
def test_pairs_match_brute_force(spark, hot):
    texts = corpus()
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "rec string, text string, digest string")
    links, members = S.shared_spans(df, min_chars=120, hot=hot)
    got = {(r.rec_a, r.rec_b): r for r in links.collect()}
    pairs = [tuple(r) for r in S.all_pairs(links, members).collect()]
    keys = sorted(texts)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(texts[a] or "") >= 120 and len(texts[b] or "") >= 120 and longest_common(texts[a], texts[b]) >= 120}
    assert sorted(pairs) == sorted(want) and set(got) == want - {("same1", "same2")} and ("edge1", "edge2") in want and ("edge0", "edge1") not in want
    for (a, b), r in got.items():
        for s in r.spans_a:
            assert texts[a][s.s : s.s + 120] in texts[b] and texts[a][s.e - 120 : s.e] in texts[b]


def test_latest_version_counts(spark):
    one, two = "q" + "lorem ipsum dolor " * 20, "other words entirely, nothing in common with them at all " * 5
    df = spark.createDataFrame([("a", one, 1), ("a", two, 2), ("b", one, 1), ("b", one, 1), ("c", two, 1)], "rec string, text string, v int").selectExpr("rec", "text", "timestamp_seconds(v) v")
    assert [tuple(r) for r in S.all_pairs(*S.shared_spans(df, version="v")).collect()] == [("a", "c")]


def test_shares(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "rec string, text string")
    rows = {r.rec: r for r in S.shared_shares(df, *S.shared_spans(df, min_chars=120)).collect()}
    assert len(rows) == len(texts) and rows["same1"].share == 1.0 and rows["same1"].partners == 1
    assert rows["null"].n_chars is None and rows["null"].share is None and rows["empty"].shared_chars == 0
    assert 250 <= rows["span0"].shared_chars <= 270 and rows["span0"].partners == 3 and rows["stock1"].shared_chars == 0


def test_empty_and_limits(spark):
    empty = spark.createDataFrame([], "rec string, text string")
    links, members = S.shared_spans(empty)
    assert links.count() == 0 and members.count() == 0 and S.all_pairs(links, members).count() == 0
    with pytest.raises(ValueError):
        S.shared_spans(empty, min_chars=50)


def test_gear_hash_and_boundaries():
    data = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(S.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert S.gear_hash(data).tolist() == want
    g = S.gear_hash(data).tolist()
    brute = sorted({max(range(i, i + 40), key=lambda k: (-g[k], k)) for i in range(len(g) - 39)})
    assert S.boundaries(data, 40).tolist() == brute
    # a boundary depends on its surroundings only
    shifted = np.concatenate([np.arange(77, dtype=np.uint8), data])
    assert set((S.boundaries(data, 40)[3:-3] + 77).tolist()) <= set(S.boundaries(shifted, 40).tolist())


def test_copies_are_one_class(spark):
    r = random.Random(8)
    base = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    rows = [(f"c{i:03}", base) for i in range(200)] + [("x", "before " + base[50:350] + " after"), ("y", base[60:360] + ".")]
    df = spark.createDataFrame(rows, "rec string, text string")
    links, members = S.shared_spans(df)
    assert {(x.rec_a, x.rec_b) for x in links.collect()} == {("c000", "x"), ("c000", "y"), ("x", "y")}
    assert {x.rec: x.rep for x in members.collect()} == {**{f"c{i:03}": "c000" for i in range(200)}, "x": "x", "y": "y"}
    assert S.all_pairs(links, members).distinct().count() == S.all_pairs(links, members).count() == 200 * 199 // 2 + 400 + 1
    shares = {x.rec: x for x in S.shared_shares(df, links, members).collect()}
    assert shares["c007"].share == 1.0 and shares["c007"].partners == 201 and shares["x"].partners == 201 and shares["x"].shared_chars == 300
