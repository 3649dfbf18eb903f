"""Statistics on small records with known results."""

import numpy as np
import pytest

from caseloom.functions.numbers import LCG_SEED
from caseloom.operators import stats

USAGE = "struct<modelCalls:bigint,tokensIn:bigint,tokensOut:bigint,costUsd:double,models:array<string>>"
DDL = f"ord bigint, suite string, task string, system string, case_id string, repetition int, output string, error string, latency_ms bigint, model_calls bigint, tokens_in bigint, tokens_out bigint, cost_usd double, models array<string>, grades array<struct<grader:string,pass:boolean,score:double,extracted:string,detail:string>>, judge {USAGE}, status string"


def records(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {"suite": "s", "task": "t", "system": "a", "case": "c1", "rep": 1, "out": "x", "error": None, "cost": None, "score": None, "extracted": None, "status": "ok", "tin": 1_000_000, "tout": 1_000_000} | r
        grades = [] if d["score"] is None else [("exact", d["score"] == 1.0, d["score"], d["extracted"], None)]
        full.append((i, d["suite"], d["task"], d["system"], d["case"], d["rep"], d["out"], d["error"], 10, 1, d["tin"], d["tout"], d["cost"], ["m"], grades, None, d["status"]))
    return spark.createDataFrame(full, DDL)


def consistency_of(spark, rows):
    return {r.task: r.consistency for r in stats.consistency(records(spark, rows)).collect()}


def test_consistency(spark):
    assert consistency_of(spark, [{"case": "c1"}, {"case": "c2"}])["ALL"] is None
    same = [{"case": "c1", "rep": i, "out": "y"} for i in range(3)]
    two = [{"case": "c2", "rep": i, "out": o} for i, o in enumerate(("p", " p ", "q"))]
    assert consistency_of(spark, same + two)["ALL"] == pytest.approx((1 + 2 / 3) / 2)
    failed = [{"out": "", "score": 1.0, "extracted": "l"}, {"out": "", "rep": 2, "error": "boom"}]
    assert consistency_of(spark, failed)["t"] == 0.5
    assert consistency_of(spark, [{"out": None}, {"out": "", "rep": 2}])["t"] == 1.0


def test_cost(spark):
    cost = lambda rows, *rates: [r.cost_usd for r in stats.summary(records(spark, rows), *rates).where("task = 'ALL'").collect()][0]
    assert cost([{}]) is None and cost([{"cost": 0.0}]) is None
    assert cost([{}], 1.0, 2.0) == 3.0 and cost([{}], 1.0, None) == 1.0
    assert cost([{"cost": 2.0}, {"rep": 2}], 1.0, 2.0) == 1.0


def test_summary_levels_and_errors(spark):
    rows = [{"task": t, "system": s, "case": f"{t}1"} for t in ("t", "u") for s in ("a", "b")] + [{"error": "x", "status": None, "rep": 2}, {"status": "grade_error", "rep": 3}, {"error": "", "status": None, "rep": 4}]
    out = {(r.task, r.system): (r.n, r.errors) for r in stats.summary(records(spark, rows)).collect()}
    assert len(out) == 6 and out["ALL", "a"] == (5, pytest.approx(0.4)) and out["t", "b"] == (1, 0.0)


def test_paired_and_bootstrap(spark):
    a = [{"system": "a", "case": f"c{i}", "score": s} for i, s in enumerate((1.0, 0.5, 0.5, 0.0))] + [{"system": "a", "case": "c0", "rep": 2, "score": 0.0}]
    b = [{"system": "b", "case": f"c{i}", "score": s} for i, s in enumerate((0.0, 0.5, 0.5, 0.0, 1.0))]
    diffs = stats.paired_differences(records(spark, a + b))
    row = stats.paired(diffs).first()
    assert (row.a, row.b, row.n, row.wins, row.ties, row.losses, row.mean_diff) == ("a", "b", 4, 1, 3, 0, 0.125)
    got = stats.bootstrap(diffs).first()
    xs, seed, means = [0.5, 0.0, 0.0, 0.0], LCG_SEED, []
    for _ in range(1000):
        total = 0.0
        for _ in range(4):
            seed = (seed * 1664525 + 1013904223) % 2**32
            total += xs[int(seed / 2**32 * 4)]
        means.append(total / 4)
    means.sort()
    assert (got.low, got.high) == (means[25], means[974])


def test_best_flags(spark):
    m = spark.createDataFrame([("s", "a", "m", 1.0, True), ("s", "b", "m", 1.0 + 1e-10, True), ("s", "c", "m", None, True), ("s", "a", "n", 1.0, False), ("s", "b", "n", 2.0, False), ("s", "a", "o", 1.0, True)], "suite string, system string, metric string, value double, higher boolean")
    assert {(r.metric, r.system) for r in stats.best_flags(m).where("best").collect()} == {("m", "a"), ("m", "b"), ("n", "a")}


def test_empty(spark):
    none = records(spark, [{}]).where("false")
    assert stats.summary(none).count() == 0 and stats.bootstrap(stats.paired_differences(none)).count() == 0
    assert np.allclose(stats.bootstrap_interval(np.array([1.0])), (1.0, 1.0))


def test_bootstrap_by_blocks():
    xs = np.random.default_rng(3).normal(size=57)
    whole = stats.bootstrap_interval(xs)
    for block in (1, 10, 57, 58, 1000, 57_000):
        assert np.allclose(stats.bootstrap_interval(xs, block=block), whole, atol=1e-12)
