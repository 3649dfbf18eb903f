"""One row per key, by both ways."""

import random

import pytest

from caseloom.operators import dedupe as D

DDL = "k string, n int, t timestamp, v string"


@pytest.mark.parametrize("wide", [False, True])
def test_latest(spark, wide, monkeypatch):
    import datetime as dt

    monkeypatch.setattr(D, "BITS", 1 << 16)
    r = random.Random(1)
    at = lambda i: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i)
    rows = [(f"k{r.randrange(3000)}", 1, at(i), f"v{i}") for i in range(4000)] + [("hot", 1, at(i), f"v{i}") for i in range(2000)] + [(None, 1, at(1), "a"), (None, 1, at(2), "b"), ("n", 1, None, "a"), ("n", 1, at(1), "b"), ("same", 1, at(1), "a"), ("same", 1, at(1), "a"), ("null", 1, None, "a")]
    want = {}
    for k, _, t, v in rows:
        if k not in want or (t or dt.datetime.min) >= (want[k][0] or dt.datetime.min):
            want[k] = (t, v)
    df = spark.createDataFrame(rows, DDL)
    out = D.latest_by(df, ["k", "n"], "t", wide=wide).collect()
    assert len(out) == len(want) and {x.k: x.v for x in out} == {k: v for k, (_, v) in want.items()}
    assert D.latest_by(df, ["k"], "t", ["v"], wide=wide).columns == ["k", "v"] and D.latest_by(df.where("false"), ["k"], "t", wide=wide).count() == 0
