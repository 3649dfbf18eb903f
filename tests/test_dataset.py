"""Dataset building against plain loops: chunks, spans, picks, balance, order, case pairs."""

import re

import pytest
from pyspark.sql import functions as F

from caseloom.functions.numbers import permutation
from caseloom.operators import dataset as D
from caseloom.operators import grid


def loop_chunks(text, limit):
    bounds, start, words, last = [], 0, 0, 0
    for m in re.finditer(r"[.!?]+\s+", text):
        words += len(text[last : m.end()].split())
        last = m.end()
        if words >= limit:
            bounds.append((start, m.end()))
            start, words = m.end(), 0
    if start < len(text):
        bounds.append((start, len(text)))
    return bounds


def test_chunks(spark):
    texts = ["", "One. Two! Three? " * 9, "no end at all", "A b. C d.  ", "é ü. " * 7 + "x", "Sect 4.4 stays. Next", None, "a. " * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string")
    got = {}
    for r in D.chunk(df, "k", "text", 4).collect():
        got.setdefault(r.k, []).append((r.part, r.start, r.end))
        assert r.passage == " ".join(texts[r.k][r.start : r.end].split())
    for i, t in enumerate(texts):
        assert [x[1:] for x in sorted(got.get(i, []))] == (loop_chunks(t, 4) if t else [])


def test_overlap(spark):
    b = spark.createDataFrame([([(0, 5), (5, 9), (9, 12)],)], "b array<struct<start:int,end:int>>")
    hit = lambda s, e: b.select(D.overlapping(F.col("b"), F.lit(s), F.lit(e)).alias("v")).first().v
    assert hit(4, 6) == [0, 1] and hit(5, 5) == [] and hit(0, 12) == [0, 1, 2] and hit(12, 15) == [] and hit(8, 9) == [1]


def test_round_robin(spark):
    rows = [("t", a, i) for i, a in enumerate("yynynmyyn")] + [("u", "x", 1)]
    df = spark.createDataFrame(rows, "task string, answer string, idx int")
    out = D.round_robin(df, "task", "answer", "idx", 5).orderBy("task", "pick").collect()
    assert [(r.answer, r.idx) for r in out if r.task == "t"] == [("y", 0), ("n", 2), ("m", 5), ("y", 1), ("n", 4)] and len(out) == 6


def loop_balance(contracts, types, multi):
    used, out = {}, []
    for name, qas in contracts:
        i = len(out)
        absent = i % 10 in (2, 5, 8)
        fit = [q for q in qas if q[0] in types and (q[1] > 0) != absent]
        if not fit:
            continue
        if multi and any(q[1] > 1 for q in fit):
            fit = [q for q in fit if q[1] > 1]
        q = sorted(fit, key=lambda q: (used.get(q[0], 0), types.index(q[0])))[0]
        used[q[0]] = used.get(q[0], 0) + 1
        out.append((i, name, q[0], absent))
    return out


@pytest.mark.parametrize("multi", [False, True])
def test_balance(spark, multi):
    types = ["A", "B", "C"]
    contracts = [(f"k{i}", [(t, (i * j) % 3) for j, t in enumerate("ABCX", 1) if (i + j) % 4]) for i in range(40)]
    df = spark.createDataFrame([(n, i, q) for i, (n, q) in enumerate(contracts)], "contract string, place int, qas array<struct<category:string,n_answers:int>>")
    want = loop_balance(contracts, types, multi)
    for parts in (1, 5):
        assert sorted(map(tuple, D.greedy_balance(df.repartition(parts), types, multi).collect())) == want
        assert sorted(map(tuple, D.greedy_balance(df.repartition(parts), types, multi, skip=4).collect())) == want[4:]
    assert D.greedy_balance(df.where("false"), types).count() == 0


def test_seeded_order(spark):
    df = spark.createDataFrame([(c,) for c in "dbacfe"], "k string")
    got = {r.k: r.place for r in D.seeded_order(df.repartition(3), "k", ["k"]).collect()}
    assert got == {"abcdef"[i]: p for p, i in enumerate(permutation(6))}


def test_case_pairs_and_labels(spark):
    rows = spark.createDataFrame([(7, "What?", [("T", "x")], [], "s")], "i int, question string, docs array<struct<title:string,text:string>>, clauses array<struct<text:string,passages:array<int>>>, source string")
    pub, priv = D.case_pairs(rows, "cuad", "cuad", "Do it.", ["clause-recall"])
    p = pub.first()
    assert (p.id, p.input) == ("cuad-007", "Question: What?\n\nDocument [1](Title: T): x") and "clauses" not in pub.columns and priv.first().graders == ["clause-recall"]
    template = spark.createDataFrame([("t-000", "t", "lb", "I", None, "q?", ["Yes"])], "id string, task string, suite string, instructions string, examples array<struct<q:string,a:string>>, question string, choices array<string>")
    new = spark.createDataFrame([("t", 0, "a", "Yes"), ("t", 1, " b ", "No"), ("u", 1, "c", "No")], "task string, idx int, text string, answer string")
    out = D.label_cases(new, template, template.select("id")).collect()
    assert [(r.id, r.input, r.question) for r in out] == [("t-001", "b", "q?")]
    demo = spark.createDataFrame([([],), ([("a", [0, 2])],)], "clauses array<struct<text:string,passages:array<int>>>").select(D.demo_answer(F.col("clauses"), "Exit").alias("v")).collect()
    assert [r.v for r in demo] == ['The contract has no "Exit" clause.', 'The contract has a "Exit" clause, which reads: "a" [1][3].']


def test_grid(spark):
    systems = spark.createDataFrame([("a", ["s"]), ("b", None), ("c", ["none"]), ("d", ["s", "s"])], "name string, suites array<string>")
    cases = spark.createDataFrame([("s-1", "s"), ("s-2", "s"), ("u-1", "u")], "id string, suite string")
    jobs = grid.job_grid(systems, cases, 2)
    assert jobs.groupBy("system").count().collect() and {r.system: r["count"] for r in jobs.groupBy("system").count().collect()} == {"a": 4, "b": 6, "d": 4}
    placed = {(r.system, r.repetition, r.case_id): (r.system_ord, r.case_ord) for r in grid.canonical_order(jobs).collect()}
    assert placed["b", 2, "u-1"] == (2, 3) and placed["a", 1, "s-2"] == (1, 2)
    r = spark.createDataFrame([(True, True, True, True), (False, True, True, True), (True, False, True, False), (True, True, False, True), (True, True, True, False)], "a boolean, b boolean, c boolean, d boolean")
    assert [x.v for x in r.select(grid.gate(*map(F.col, "abcd")).alias("v")).collect()] == [200, 401, 404, 403, 429]


def test_pages(spark):
    df = spark.range(10).withColumnRenamed("id", "place")
    assert sorted(r.place for r in D.page(df, "place", 3, 4).collect()) == [3, 4, 5, 6] and D.exactly(df, "place", 10).count() == 10 and D.exactly(df, "place", 0).count() == 0
    with pytest.raises(ValueError, match="10 rows instead of 11"):
        D.exactly(df, "place", 11)


def test_numbered(spark):
    from caseloom.operators.order import numbered

    rows = [("hot" if i % 3 else None, (i * 7919) % 1000) for i in range(900)]
    out = numbered(spark.createDataFrame(rows, "g string, v int").repartition(5), ["v"], "n", ["g"]).collect()
    for g in ("hot", None):
        own = sorted((r.v, r.n) for r in out if r.g == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert sorted(r.n for r in numbered(spark.range(50), ["id"], "n").collect()) == list(range(1, 51)) and numbered(spark.range(0), ["id"], "n").count() == 0
