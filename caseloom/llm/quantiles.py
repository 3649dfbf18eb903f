"""Percentiles of very large numeric columns from mergeable dyadic summaries (q-digests).

A value is quantized to a bounded ordered universe: sign, binary exponent (EXPONENTS of them) and MANTISSA bits, so the
relative error of a value is at most 2 ** -(MANTISSA + 1). The universe is the leaf level of a binary tree; a summary holds
counts at nodes of the tree. It is compressed bottom-up: a node, its sibling and their parent are folded into the parent
when together they hold at most floor(error * n / HEIGHT) values. Summaries are merged by adding the counts node by node and
compressed again. Any rank is then off by at most error * n, whatever the data and the order of merging.

Summaries are plain rows (keys, node, count), so those of single files or days can be kept and combined later.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MANTISSA = 9
#: Exponents from -64 to 63: magnitudes below 2 ** -64 count as 0, from 2 ** 64 on as the largest.
EXPONENTS = 128
HALF = EXPONENTS << MANTISSA
UNIVERSE = 2 * HALF
HEIGHT = UNIVERSE.bit_length() - 1
VALUE_ERROR = 2.0 ** -(MANTISSA + 1)
RANK_ERROR = 0.002


def leaf(value: Column) -> Column:
    """The place of a value in the universe, in the values' order; NULL for NULL and NaN.

    floor(log2) may be off by one at powers of two; the scale is continuous there, so the order and the error hold.
    """
    v = value.cast("double")
    size = F.least(F.abs(v), F.lit(2.0**64 - 2.0**12))
    e = F.floor(F.log2(F.when(size > 0, size)))
    place = (e + EXPONENTS // 2) * (1 << MANTISSA) + F.floor((size / F.pow(F.lit(2.0), e) - 1) * (1 << MANTISSA))
    place = F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(HALF - 1))
    signed = F.when(v < 0, HALF - 1 - place).otherwise(HALF + place)
    return F.when(v.isNotNull() & ~F.isnan(v), signed).cast("int")


def value_of(place: Column) -> Column:
    """The middle of a leaf's values; 0 for the leaves next to zero."""
    p = F.when(place >= HALF, place - HALF).otherwise(HALF - 1 - place)
    size = F.pow(F.lit(2.0), F.floor(p / (1 << MANTISSA)) - EXPONENTS // 2) * (1 + (p % (1 << MANTISSA) + 0.5) / (1 << MANTISSA))
    return F.when(p == 0, F.lit(0.0)).when(place >= HALF, size).otherwise(-size)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fold light nodes into their parents, from the leaves up, for many summaries at once.

    group: index of each node's summary; limit: per summary, the most that a node with its sibling and parent may hold to be
    folded. A node's number is 1 for the root and 2 * p, 2 * p + 1 below p; leaves are UNIVERSE + place.
    """
    group, node, count = group.astype(np.int64), node.astype(np.int64), count.astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in range(HEIGHT, 0, -1):
        low = 1 << level
        here = node >= low
        if not here.any():
            continue
        g, v, c = group[here], node[here], count[here]
        above = (node >= low >> 1) & ~here
        # families: the parent's key of every node on this level, and the parents' own counts
        family = np.concatenate([g * (low >> 1) + (v >> 1) - (low >> 1), group[above] * (low >> 1) + node[above] - (low >> 1)])
        keys, at = np.unique(family, return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([c, count[above]]).astype(np.float64), minlength=len(keys)).astype(np.int64)
        fold = total <= limit[keys // (low >> 1)]
        own = at[: len(v)]
        stay = ~fold[own]
        done.append((g[stay], v[stay], c[stay]))
        # a folded family is one node on the parents' level; its parent must not be counted again
        rest = ~here
        rest[np.flatnonzero(above)[fold[at[len(v) :]]]] = False
        child = np.zeros(len(keys), bool)
        child[own] = True
        up = np.flatnonzero(fold & child)
        lost = np.flatnonzero(fold & ~child)  # parents alone stay as they are
        more = np.concatenate([up, lost])
        group = np.concatenate([group[rest], keys[more] // (low >> 1)])
        node = np.concatenate([node[rest], keys[more] % (low >> 1) + (low >> 1)])
        count = np.concatenate([count[rest], total[more]])
    done.append((group, node, count))
    return tuple(np.concatenate(x) for x in zip(*done))


def compressed(nodes: DataFrame, keys: Sequence[str], error: float = RANK_ERROR) -> DataFrame:
    """Summaries (keys, node, count) compressed to the error; at most 3 * HEIGHT / error nodes each.

    A summary has at most 2 * UNIVERSE rows before, so a group is bounded whatever the number of values behind it.
    """
    keys = list(keys)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*keys, "node", "count").schema.fields)
    sorted_nodes = nodes.select(*keys, "node", "count").repartition(*keys).sortWithinPartitions(*keys)
    names = [*keys, "node", "count"]

    def fold(table: pa.Table, change: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(change) - 1
        first = np.flatnonzero(change)
        count = table.column("count").to_numpy()
        n = np.bincount(group, weights=count.astype(np.float64))
        g, v, c = compress(group, table.column("node").to_numpy(), count, np.floor(error * n / HEIGHT).astype(np.int64))
        rows = table.select(keys).take(pa.array(first[g]))
        return pa.Table.from_arrays([*rows.columns, pa.array(v.astype(np.int32)), pa.array(c)], names).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def starts(table: pa.Table) -> np.ndarray:
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for k in keys:
                codes = table.column(k).combine_chunks().dictionary_encode()
                codes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            return change

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= 200_000:
                table = pa.Table.from_batches(held)
                change = starts(table)
                last = int(np.flatnonzero(change)[-1])  # the last summary may go on in the next batch
                if last:
                    yield from fold(table.slice(0, last), change[:last]).to_batches()
                held = table.slice(last).to_batches()
                rows = table.num_rows - last
        if rows:
            table = pa.Table.from_batches(held)
            yield from fold(table, starts(table)).to_batches()

    return sorted_nodes.mapInArrow(run, ddl)


def summaries(df: DataFrame, keys: Sequence[str], value: str, error: float = RANK_ERROR) -> DataFrame:
    """A summary of `value` per group: keys, node, count (bigint). NULL and NaN are no values; a group without values has no
    rows. Counts are aggregated by leaf before anything is shuffled."""
    leaves = df.select(*keys, (leaf(F.col(value)) + UNIVERSE).alias("node")).where("node is not null")
    return compressed(leaves.groupBy(*keys, "node").agg(F.count("*").alias("count")), keys, error)


def merged(nodes: DataFrame, keys: Sequence[str], error: float = RANK_ERROR) -> DataFrame:
    """Summaries of parts (rows may repeat a group's node) as summaries of their union, per `keys`."""
    return compressed(nodes.groupBy(*keys, "node").agg(F.sum("count").alias("count")), keys, error)


def percentiles(nodes: DataFrame, keys: Sequence[str], ranks: Sequence[float], error: float = RANK_ERROR) -> DataFrame:
    """keys, n, q, value, place, rank_error, value_error: for each q the value whose rank is within error * n of q * n."""
    level = F.floor(F.log2(F.col("node").cast("double") + 0.25)).cast("int")
    shift = F.lit(HEIGHT) - level
    high = (F.pow(F.lit(2.0), shift) * (F.col("node") + 1)).cast("bigint") - 1 - UNIVERSE
    order = Window.partitionBy(*keys).orderBy("high", F.desc("node"))
    seen = nodes.withColumn("high", high).withColumn("upto", F.sum("count").over(order))
    n = seen.withColumn("n", F.sum("count").over(Window.partitionBy(*keys)))
    each = n.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n"))), F.col("high"))).alias(f"p{i}") for i, q in enumerate(ranks)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"p{i}").cast("int").alias("place")) for i, q in enumerate(ranks)])).alias("r")
    out = each.select(*keys, "n", rows)
    return out.select(*keys, "n", "r.q", value_of(F.col("r.place")).alias("value"), "r.place", F.lit(error).alias("rank_error"), F.lit(VALUE_ERROR).alias("value_error"))
