"""Packing: every token once, capacities held, little space left, neighbours together."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import packing as K
from caseloom.llm import tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_pack(sizes):
    out = K.pack(sizes, 50, None)
    assert sorted(i for c in out for i in c) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in c) <= 50 for c in out)
    full = [sum(sizes[i] for i in c) for c in out]
    # two containers that fit into one are never left
    assert all(a + b > 50 for k, a in enumerate(full) for b in full[k + 1 :]) or not sum(sizes)


def test_bm25_ranks_by_shared_rare_terms():
    docs = [[1, 2, 3], [1, 2, 9], [1, 8, 9], [7], [1, 1, 1]]
    flat, off = np.concatenate([np.unique(d) for d in docs]), np.cumsum([0, *[len(set(d)) for d in docs]])
    counts = np.concatenate([np.unique(d, return_counts=True)[1] for d in docs])
    df = np.bincount(flat, minlength=10)
    idf = np.where(df > 0, np.log(1 + (5 - df + 0.5) / (df + 0.5)), 0).astype(np.float32)
    index = K.Index(flat, counts, off, idf, 3.0)
    free = np.array([3, 3, 3, 1, 3])
    assert index.neighbours(0, free, 99)[:2] == [0, 1] and index.neighbours(3, np.where(np.arange(5) == 3, 0, free), 99) == []
    assert index.neighbours(0, np.array([0, 0, 3, 1, 9]), 3) == [2]


def test_documents(spark):
    r = random.Random(2)
    topics = [[f"w{t}x{i}" for i in range(30)] for t in range(6)]
    rows = [(i, " ".join(r.choices(topics[i % 6], k=r.randint(1, 60)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "word " * 2000), (903, "a" * 40_000), (904, rows[0][1]), (905, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sized = K.with_tokens(df, "doc_id", "text")
    encode = tokens.encoder(tokens.vocabulary())
    want = {i: len(encode(t)) if t else 0 for i, t in rows}
    assert {x.doc_id: x.tokens for x in sized.collect()} == want
    for shard in (10**9, 2000):
        out = K.pack_documents(sized, {1: 100, 2: 512}, "doc_id", shard_tokens=shard).collect()
        for spec, cap in ((1, 100), (2, 512)):
            mine = [x for x in out if x.spec_id == spec]
            inside, got = {}, {}
            for x in mine:
                inside[x.container] = inside.get(x.container, 0) + x.tokens
                got.setdefault(x.doc_id, []).append((x.part, x.first_token, x.tokens))
            assert max(inside.values()) <= cap and set(got) == set(want)
            for k, parts in got.items():
                parts.sort()
                assert sum(p[2] for p in parts) == want[k] and [p[0] for p in parts] == list(range(1, len(parts) + 1))
                assert [p[1] for p in parts] == [sum(q[2] for q in parts[:j]) for j in range(len(parts))]
                assert len(parts) == max(1, -(-want[k] // cap))
            assert sum(want.values()) / (len(inside) * cap) > (0.9 if shard > 2000 else 0.8)
    report = {r.spec_id: r for r in K.packing_report(K.pack_documents(sized, {1: 100}, "doc_id"), spark.createDataFrame([(1, 100)], "spec_id int, capacity_tokens int"), "doc_id").collect()}
    assert report[1].documents == len(want) and report[1].tokens == sum(want.values())


def test_neighbours_share_a_container(spark):
    r = random.Random(4)
    topics = [[f"{w}{t}" for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma")] for t in range(20)]
    rows = [(i, " ".join(r.choices(topics[i % 20], k=12))) for i in range(200)]
    sized = K.with_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    out = K.pack_documents(sized, {1: 200}, "doc_id").collect()
    by = {}
    for x in out:
        by.setdefault(x.container, []).append(x.doc_id % 20)
    same = sum(a == b for c in by.values() for k, a in enumerate(c) for b in c[k + 1 :]) / max(1, sum(len(c) * (len(c) - 1) // 2 for c in by.values()))
    assert same > 0.3  # by chance a twentieth


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert K.pack_documents(K.with_tokens(none, "doc_id", "text"), {1: 10}, "doc_id").count() == 0


SIZED = "doc_id bigint, tokens int, terms array<int>, counts array<int>"


def test_terms_of_a_seventh_of_the_documents_retrieve_neighbours(spark):
    r = random.Random(6)
    rows = [(i, 10, [i % 7], [10]) for i in range(140)]
    r.shuffle(rows)
    by = {}
    for x in K.pack_documents(spark.createDataFrame(rows, SIZED), {1: 100}, "doc_id").collect():
        by.setdefault(x.container, set()).add(x.doc_id % 7)
    assert len(by) == 14 and all(len(topics) == 1 for topics in by.values())


def test_nearly_full_containers_are_repacked(spark):
    # 97 and 3 tokens in different shards of the first round; the second has one shard
    rows = [(i, 100, [i], [100]) for i in range(20)] + [(100, 97, [100], [97]), (102, 3, [102], [3])]
    out = K.pack_documents(spark.createDataFrame(rows, SIZED), {1: 100}, "doc_id", shard_tokens=100).collect()
    of = {x.doc_id: x.container for x in out}
    assert of[100] == of[102] and len(set(of.values())) == 21
