"""Summaries: rank error within bounds for any data and any merging; the order of the universe."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.llm import quantiles as Q

RANKS = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)


def holds(values, row, error, n):
    """Whether the answer's rank is within error * n of q * n; the answer stands for all values of its leaf."""
    lo, hi = row.value * (1 - np.sign(row.value) * Q.VALUE_ERROR * 1.01), row.value * (1 + np.sign(row.value) * Q.VALUE_ERROR * 1.01)
    below, upto = (values < lo).sum(), (values <= hi).sum()
    return below <= row.q * n + error * n + 1 and upto >= row.q * n - error * n - 1


@pytest.mark.parametrize("error", [0.05, 0.002])
def test_rank_error_also_after_merging(spark, error):
    rng = np.random.default_rng(3)
    parts = [rng.lognormal(8, 2, 3000), -rng.exponential(5, 500), np.zeros(300), np.repeat(1234.5, 900), rng.uniform(0, 1e-5, 400)]
    rows = [(f"d{i}", float(v)) for i, p in enumerate(parts) for v in p]
    df = spark.createDataFrame(rows, "day string, v double")
    days = Q.summaries(df, ["day"], "v", error)
    whole = Q.merged(days.withColumn("all", F.lit(1)), ["all"], error)
    values = np.concatenate(parts)
    for row in Q.percentiles(whole, ["all"], RANKS, error).collect():
        assert row.n == len(values) and holds(values, row, error, len(values)), row
    for i, p in enumerate(parts):
        for row in Q.percentiles(days.where(F.col("day") == f"d{i}"), ["day"], RANKS, error).collect():
            assert holds(p, row, error, len(p)), row
    assert whole.count() <= 3 * Q.HEIGHT / error


def test_null_is_no_value(spark):
    df = spark.sql("select * from values ('a', 0.0D), ('a', null), ('a', double('nan')), ('b', null), (null, 7.0D) t(k, v)")
    out = {r.k: (r.n, r.value) for r in Q.percentiles(Q.summaries(df, ["k"], "v"), ["k"], [0.5]).collect()}
    assert set(out) == {"a", None} and out["a"] == (1, 0.0) and out[None][1] == pytest.approx(7.0, rel=Q.VALUE_ERROR)
    assert Q.summaries(df.where("false"), ["k"], "v").count() == 0


def test_order_and_error_of_values(spark):
    values = sorted([0.0, 1e-30, -1e-30, 1.0, 2.0, 4.0, 0.1, 1e9, -1e9, 3.0, -0.5, 7.3e-7, 1e300, -1e300, 2**53 + 0.0, 8.0, 1024.0])
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", Q.leaf(F.col("v")).alias("p")).withColumn("back", Q.value_of(F.col("p"))).orderBy("v").collect()
    places = [r.p for r in rows]
    assert places == sorted(places) and min(places) >= 0 and max(places) < Q.UNIVERSE
    for r in rows:
        if 2.0**-63 < abs(r.v) < 2.0**63:
            assert abs(r.back - r.v) <= abs(r.v) * Q.VALUE_ERROR * 1.001


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, Q.UNIVERSE - 1), st.integers(1, 50)), min_size=1, max_size=120), st.integers(0, 60))
def test_compress_keeps_counts_and_bound(items, limit):
    g, x, c = (np.array(v) for v in zip(*items))
    limits = np.full(4, limit)
    group, node, count = Q.compress(g, x + Q.UNIVERSE, c, limits)
    for k in range(4):
        assert count[group == k].sum() == c[g == k].sum()
        inner = (group == k) & (node < Q.UNIVERSE)
        assert (count[inner] <= limit).all()
        # every count stands at an ancestor of its leaf: counts below any node never grow
        for n, total in zip(node[group == k], count[group == k]):
            low, high = int(n), int(n)
            while low < Q.UNIVERSE:
                low, high = 2 * low, 2 * high + 1
            inside = (g == k) & (x + Q.UNIVERSE >= low) & (x + Q.UNIVERSE <= high)
            assert total <= c[inside].sum()
