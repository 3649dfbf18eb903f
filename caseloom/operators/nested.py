"""Deeply nested records as flat tables linked by interval labels.

Every record is a tree: the record is the root, every element of every array is a node. A depth-first walk numbers the
nodes; a node carries its pre-order number `pre`, its post-order number `post` and its depth. A node lies below another
one of the same record exactly when its interval lies within the other's: `a.pre < d.pre and d.post < a.post`. One table
comes out per array path, with the node's scalar members beside its labels.

The numbers are computed from subtree sizes by column expressions inside the scan's stage: nothing is shuffled and
nothing leaves the JVM. NULL elements keep their place (they use up one number) but are no node.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ("pre", "post", "depth", "parent_pre", "place")


@dataclass
class Node:
    """One array of the schema. `path` leads from the parent element to the array, through structs only."""

    name: str
    path: tuple[str, ...]
    element: T.DataType
    leaves: list[tuple[str, ...]] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


def _walk(kind: T.StructType, prefix: tuple[str, ...], node: Node) -> None:
    for f in kind.fields:
        path = (*prefix, f.name)
        if isinstance(f.dataType, T.StructType):
            _walk(f.dataType, path, node)
        elif isinstance(f.dataType, T.ArrayType):
            child = Node("_".join(path), path, f.dataType.elementType)
            if isinstance(child.element, T.StructType):
                _walk(child.element, (), child)
            node.children.append(child)
        else:
            node.leaves.append(path)


def tree_of(schema: T.StructType, keys: list[str]) -> Node:
    """The tree of a schema: children in the order of the schema's members. Maps and scalars are members of their node."""
    root = Node("records", (), schema)
    _walk(T.StructType([f for f in schema.fields if f.name not in keys]), (), root)
    return root


def _at(base: Column, path: tuple[str, ...]) -> Column:
    for p in path:
        base = base.getField(p)
    return base


def _array_size(base: Column, child: Node) -> Column:
    """Numbers used up by an array: one for each place of a scalar or NULL, the subtree's size for a struct."""
    arr = _at(base, child.path)
    if not child.children:
        n = F.size(arr)
        return F.when(n > 0, n).otherwise(F.lit(0))
    total = F.aggregate(arr, F.lit(0), lambda acc, e: acc + _size(e, child))
    return F.coalesce(total, F.lit(0))


def _size(base: Column, node: Node) -> Column:
    below = F.lit(1)
    for c in node.children:
        below = below + _array_size(base, c)
    return F.when(base.isNull(), F.lit(1)).otherwise(below)


def _starts(base: Column, child: Node) -> tuple[Column, Column]:
    """Of each place of an array: the numbers used before it, and its subtree's size."""
    arr = _at(base, child.path)
    sizes = F.transform(arr, lambda e: _size(e, child))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return starts, sizes


def _scalar_columns(base: Column, node: Node, taken: set[str]) -> list[Column]:
    out, used = [], set(taken)
    for path in node.leaves:
        name = "_".join(path)
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(_at(base, path).alias(name))
    return out


def flatten(df: DataFrame, keys: list[str], only: set[str] | None = None) -> dict[str, DataFrame]:
    """Flat tables of nested records: `records` and one table per array, named by its path ("run_trace_stages").

    keys: columns that identify a record; they come out unchanged in every table. only: names of the tables wanted; the
    numbering is the same whichever are asked for. Each table has the keys, `pre`, `post`, `depth`, `parent_pre` (the
    nearest node above), `place` (1-based place in its array, NULL elements counted) and the scalar members of the node,
    named by their path; a scalar element is the column `value`. A member whose name clashes with one of these gets an
    underscore. NULL or empty arrays give no row; NULL elements give none and keep their place; an empty string is an
    element. A record loaded twice comes out twice: use `latest_by` before.
    """
    root = tree_of(df.schema, keys)
    taken = {k.lower() for k in keys} | set(LABELS)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    base = df.select(*keys, row.alias("__e"), F.lit(1).alias("pre"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("parent_pre"), F.lit(1).alias("place"))
    base = base.withColumn("__size", _size(F.col("__e"), root))
    out: dict[str, DataFrame] = {}

    def emit(node: Node, nodes: DataFrame, name: str) -> None:
        if only is None or name in only:
            post = F.col("pre") + F.col("__size") - 1 - F.col("depth")
            values = _scalar_columns(F.col("__e"), node, taken) if isinstance(node.element, T.StructType) else [F.col("__e").alias("value")]
            out[name] = nodes.select(*keys, "pre", post.alias("post"), "depth", "parent_pre", "place", *values)
        before: Column = F.lit(1)
        for c in node.children:
            deeper = name + "_" + c.name if node is not root else c.name
            if only is None or any(o == deeper or o.startswith(deeper + "_") for o in only):
                emit(c, _below(node, nodes, c, before), deeper)
            before = before + _array_size(F.col("__e"), c)

    def _below(node: Node, nodes: DataFrame, c: Node, before: Column) -> DataFrame:
        arr = _at(F.col("__e"), c.path)
        here = nodes.select(*keys, F.col("pre").alias("parent_pre"), (F.col("depth") + 1).alias("depth"), (F.col("pre") + before).alias("__first"), arr.alias("__arr"), *([x.alias(n) for x, n in zip(_starts(F.col("__e"), c), ("__starts", "__sizes"))] if c.children else []))
        flat = here.select("*", F.posexplode("__arr").alias("__pos", "__e")).where(F.col("__e").isNotNull())
        if c.children:
            pre, size = F.col("__first") + F.get("__starts", F.col("__pos")), F.get("__sizes", F.col("__pos"))
        else:
            pre, size = F.col("__first") + F.col("__pos"), F.lit(1)
        return flat.select(*keys, "__e", pre.alias("pre"), "depth", "parent_pre", (F.col("__pos") + 1).alias("place"), size.alias("__size"))

    emit(root, base, "records")
    return out


def within(inner: DataFrame, outer: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Rows of `inner` with the columns (old name -> new name) of every node of `outer` that contains it.

    The join is on the record's keys, so its work stays within one record; containment of the intervals is the second
    condition. Rows of `inner` that lie in no node of `outer` drop out.
    """
    o = outer.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("pre").alias("__o_pre"), F.col("post").alias("__o_post"), *[F.col(a).alias(b) for a, b in columns.items()])
    on = (F.col("__o_pre") < F.col("pre")) & (F.col("post") < F.col("__o_post"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__o_{k}")) if inner.schema[k].nullable else on & (F.col(k) == F.col(f"__o_{k}"))
    return inner.join(o, on, "inner").select(*inner.columns, *columns.values())
