"""Interval labels against a walk of the same records in Python."""

from pyspark.sql import functions as F

from caseloom.operators.dedupe import latest_by
from caseloom.operators.nested import flatten, within

DDL = "k bigint, pre string, a struct<x:int,items:array<struct<n:string,tags:array<string>>>>, t array<int>"
ROWS = [
    (1, "p", (7, [("u", ["a", None, ""]), None, ("v", None), ("w", [])]), [1, None, 3]),
    (2, None, None, None),
    (3, "q", (None, []), []),
    (4, "r", (1, [(None, ["z"])]), None),
]


def walk(row):
    """(kind, pre, post, depth, place) in depth-first order; a NULL uses up a number and is no node."""
    out, pre = [], [0]
    post = [0]

    items = (row[2][1] if row[2] else None) or []
    below = [("a_items", i, [("a_items_tags", t, [], j + 1) for j, t in enumerate((i[1] if i else None) or [])], k + 1) for k, i in enumerate(items)]
    below += [("t", x, [], k + 1) for k, x in enumerate(row[3] or [])]
    fix = lambda c: (c[0], c[1], [fix(x) for x in c[2]], c[3])

    def run(c, depth):
        kind, value, children, place = c
        pre[0] += 1
        mine = pre[0]
        for x in children:
            run(x, depth + 1)
        post[0] += 1
        if value is not None:
            out.append((kind, mine, post[0], depth, place))

    run(("records", row, [fix(c) for c in below], 1), 0)
    return sorted(out)


def test_labels_match_a_walk(spark):
    df = spark.createDataFrame(ROWS, DDL)
    tables = flatten(df, ["k"])
    assert set(tables) == {"records", "a_items", "a_items_tags", "t"}
    for row in ROWS:
        got = sorted((name, r.pre, r.post, r.depth, r.place) for name, t in tables.items() for r in t.where(F.col("k") == row[0]).collect())
        assert got == walk(row)


def test_names_that_clash_and_links(spark):
    tables = flatten(spark.createDataFrame(ROWS, DDL), ["k"])
    assert {"pre", "pre_"} <= set(tables["records"].columns)  # the member `pre` beside the label
    found = within(tables["a_items_tags"], tables["a_items"], ["k"], {"place": "item", "n": "name"}).orderBy("k", "pre").collect()
    assert [(r.k, r.item, r.name, r.place, r.value) for r in found] == [(1, 1, "u", 1, "a"), (1, 1, "u", 3, ""), (4, 1, None, 1, "z")]
    # containment and the parent's number say the same
    same = tables["a_items_tags"].alias("c").join(tables["a_items"].alias("p"), (F.col("c.k") == F.col("p.k")) & (F.col("c.parent_pre") == F.col("p.pre")))
    assert same.count() == 3


def test_empty_table_and_only(spark):
    empty = spark.createDataFrame([], DDL)
    tables = flatten(empty, ["k"], only={"a_items_tags"})
    assert list(tables) == ["a_items_tags"] and tables["a_items_tags"].count() == 0


def test_latest_by(spark):
    df = spark.sql("select * from values (1, timestamp'2026-01-01', 'old'), (1, timestamp'2026-01-02', 'new'), (2, null, 'only'), (null, timestamp'2026-01-01', 'n') t(k, at, v)")
    assert {(r.k, r.v) for r in latest_by(df, ["k"], "at").collect()} == {(1, "new"), (2, "only"), (None, "n")}
    assert latest_by(df.where("false"), ["k"], "at").count() == 0
