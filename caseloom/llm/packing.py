"""Filling containers of fixed capacity with documents that belong together.

Lexical retrieval packing: documents are spread over shards of bounded size; each shard has a BM25 inverted index (document
frequencies are counted over all documents). The largest unused document opens a container, its unused neighbours by BM25
fill it greedily in the order of their scores, and what no neighbour fits takes the largest unused document that does.
Containers that stay too empty are opened again and repacked together in a second round over all shards. A document is
split only if it alone exceeds the capacity: into full containers and a rest that is packed like any other document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut_lineage
from . import tokens

K1, B = 1.2, 0.75
#: Terms of a seed that are looked up first, those with the greatest weight; four times as many whenever the neighbours they
#: find don't fill the container, in the end all.
QUERY_TERMS = 16
SHARD_TOKENS = 2_000_000
#: A container with less than this is repacked in the second round.
FULL = 0.985

SIZES = "tokens int, terms array<int>, counts array<int>"


def with_tokens(documents: DataFrame, key: str, text: str, path: str | None = None, terms: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """key, the columns `keep`, tokens and, if terms, each document's distinct token ids with their counts; NULL and empty texts
    have 0 tokens."""
    content = tokens.vocabulary(path)
    keys = [key, *keep]
    chosen = documents.select(*keys, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    ints = pa.list_(pa.int32())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(content)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids = [encode(t) if t else [] for t in b.column(len(keys)).to_pylist()]
                own = b.columns[:-1]
                sizes = pa.array([len(x) for x in ids], pa.int32())
                if not terms:
                    yield pa.RecordBatch.from_arrays([*own, sizes], [*keys, "tokens"])
                    continue
                pairs = [tokens.distinct(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*own, sizes, pa.array([p[0] for p in pairs], ints), pa.array([p[1].astype(np.int32) for p in pairs], ints)], [*keys, "tokens", "terms", "counts"])

    return chosen.mapInArrow(count, f"{kinds}, {SIZES if terms else 'tokens int'}")


class Index:
    """BM25 over the items of a shard: postings of all terms, weights worked out beforehand."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, offsets: np.ndarray, idf: np.ndarray, mean: float):
        n = len(offsets) - 1
        self.n = n
        item = np.repeat(np.arange(n), np.diff(offsets))
        length = np.bincount(item, weights=counts, minlength=n) if len(item) else np.zeros(n)
        weight = idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length[item] / max(mean, 1.0)))
        keep = idf[terms] > 0
        terms, item, weight = terms[keep], item[keep], weight[keep].astype(np.float32)
        # of each item its terms, for when it is a seed
        self.start = np.searchsorted(item, np.arange(n + 1))
        self.terms, self.own = terms, weight
        by_term = np.argsort(terms, kind="stable")
        self.item, self.weight = item[by_term], weight[by_term]
        self.first = np.searchsorted(terms[by_term], np.arange(len(idf) + 1))

    def query(self, seed: int) -> np.ndarray:
        """An item's terms, the heaviest first."""
        a, b = self.start[seed], self.start[seed + 1]
        return self.terms[a:b][np.argsort(-self.own[a:b], kind="stable")]

    def neighbours(self, seed: int, free: np.ndarray, room: int, terms: int | None = None) -> list[int]:
        """Items that share one of the seed's heaviest terms (so many, or all), are free (their size, 0 if not) and fit, best
        first, ties by number."""
        q = self.query(seed)[:terms]
        if not len(q):
            return []
        runs = [slice(self.first[t], self.first[t + 1]) for t in q]
        item = np.concatenate([self.item[r] for r in runs])
        size = free[item]
        fits = (size > 0) & (size <= room)
        if not fits.any():
            return []
        score = np.bincount(item[fits], weights=np.concatenate([self.weight[r] for r in runs])[fits], minlength=1)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")].tolist()


def pack(sizes: Sequence[int], capacity: int, index: Index | None) -> list[list[int]]:
    """Items (0 to capacity each) in containers; every item in exactly one. Items of size 0 join the first container."""
    by_size: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda x: -x):
        if sizes[i]:
            by_size.setdefault(sizes[i], []).append(i)
    mask = 0
    for s in by_size:
        mask |= 1 << s
    used = bytearray(len(sizes))
    free = np.array(sizes, np.int64)
    out: list[list[int]] = []

    def largest(room: int) -> int | None:
        """The largest unused item that fits, the first of equals."""
        nonlocal mask
        while low := mask & ((2 << room) - 1):
            s = low.bit_length() - 1
            queue = by_size[s]
            while queue and used[queue[-1]]:
                queue.pop()
            if queue:
                return queue[-1]
            mask &= ~(1 << s)
        return None

    while (seed := largest(capacity)) is not None:
        used[seed], free[seed] = 1, 0
        inside, room = [seed], capacity - sizes[seed]
        looked = 0
        while index is not None and looked < index.start[seed + 1] - index.start[seed] and room and largest(room) is not None:
            looked = 4 * looked or QUERY_TERMS
            for i in index.neighbours(seed, free, room, looked):
                if sizes[i] <= room:
                    used[i], free[i] = 1, 0
                    inside.append(i)
                    room -= sizes[i]
                    if largest(room) is None:
                        break
        while room and (i := largest(room)) is not None:
            used[i], free[i] = 1, 0
            inside.append(i)
            room -= sizes[i]
        out.append(inside)
    empty = [i for i, s in enumerate(sizes) if not s]
    if empty:
        if out:
            out[0] += empty
        else:
            out.append(empty)
    return out


def pack_documents(sized: DataFrame, capacities: dict[int, int], key: str, shard_tokens: int = SHARD_TOKENS, vocabulary_size: int = 60_000) -> DataFrame:
    """spec_id, container, key, part, first_token, tokens: every document of `sized` (see with_tokens) in the containers of
    each capacity (spec_id -> tokens; a handful).

    part is 1 for a whole document; a document larger than the capacity has parts 1, 2, ... of which all but the last are
    full containers. Documents of 0 tokens come out too. A repeated key comes out as often as it is given.
    """
    kind = sized.schema[key].dataType.simpleString()
    if not capacities:
        raise ValueError("no capacities")
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    # as many rows as the vocabulary has entries, whatever the size of the corpus
    counted = sized.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    df = np.zeros(vocabulary_size, np.float64)
    for t, c in counted:
        df[t] = c
    idf = np.where(df > 0, np.log(1 + (n - df + 0.5) / (df + 0.5)), 0.0).astype(np.float32)
    mean = total / max(1, n)
    specs = sorted(capacities.items())

    def rows(table: pa.Table, name: str, caps: list[tuple[int, int]], whole: bool) -> Iterator[tuple]:
        sizes = table.column("tokens").to_numpy()
        terms = table.column("terms").combine_chunks()
        flat, off = terms.flatten().to_numpy(zero_copy_only=False), terms.offsets.to_numpy()
        index = Index(flat, table.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False), off - off[0], idf, mean)
        part = table.column("part").to_numpy() if not whole else np.ones(len(sizes), np.int64)
        first = table.column("first").to_numpy() if not whole else np.zeros(len(sizes), np.int64)
        for spec, capacity in caps:
            rest = sizes % capacity if whole else sizes
            rest = np.where((sizes > 0) & (rest == 0), np.minimum(sizes, capacity), rest)
            full = (sizes - rest) // capacity if whole else np.zeros(len(sizes), np.int64)
            made = 0
            for i in np.flatnonzero(full):
                for p in range(int(full[i])):
                    yield spec, f"{name}-{made}", i, p + 1, p * capacity, capacity, 1.0
                    made += 1
            for inside in pack(rest.tolist(), capacity, index):
                share = float(rest[inside].sum()) / capacity
                for i in inside:
                    yield spec, f"{name}-{made}", i, int(part[i] + full[i]), int(first[i] + full[i] * capacity), int(rest[i]), share
                made += 1

    out_kind = f"spec_id int, container string, key {kind}, part int, first_token int, tokens int, share double, terms array<int>, counts array<int>"
    names = ["spec_id", "container", "key", "part", "first_token", "tokens", "share", "terms", "counts"]
    ints = pa.list_(pa.int32())

    def emit(table: pa.Table, name: str, caps: list[tuple[int, int]], whole: bool) -> pa.Table:
        made = list(rows(table, name, caps, whole))
        cols = list(zip(*made)) or [()] * 7
        at = pa.array(cols[2], pa.int64())
        # the terms go on only with what is packed again
        again = pa.array([i if s < FULL and whole else None for i, s in zip(cols[2], cols[6])], pa.int64())
        return pa.table(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), table.column("key").take(at), *(pa.array(cols[i], pa.int32()) for i in (3, 4, 5)), pa.array(cols[6], pa.float64())]
            + [table.column(c).combine_chunks().take(again).cast(ints) for c in ("terms", "counts")],
            names,
        )

    def by_shard(df: DataFrame, count: int, work: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
        """Each shard (0 to count - 1) in a partition and task of its own; shards never collide as hashed ones do."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            for shard in sorted(set(table.column("shard").to_pylist())):
                yield from work(shard, table.filter(pc.equal(table.column("shard"), shard))).to_batches()

        return df.repartitionById(count, "shard").mapInArrow(run, out_kind)

    shards = max(1, -(-int(total) // shard_tokens))
    first_round = sized.select(F.col(key).alias("key"), "tokens", "terms", "counts", F.pmod(F.xxhash64(F.col(key)), F.lit(shards)).cast("int").alias("shard"))
    packed = cut_lineage(by_shard(first_round, shards, lambda shard, table: emit(table, f"a{shard}", specs, True)))
    done = packed.where(F.col("share") >= FULL)
    open_again = packed.where(F.col("share") < FULL)
    left = {r[0]: r[1] for r in open_again.groupBy("spec_id").agg(F.sum("tokens")).collect()}  # a row per capacity
    # the shards of all capacities are numbered through
    counts = [max(1, -(-int(left.get(spec) or 0) // shard_tokens)) for spec, _ in specs]
    starts = [sum(counts[:i]) for i in range(len(counts))]
    count = F.coalesce(*[F.when(F.col("spec_id") == spec, F.lit(k)) for (spec, _), k in zip(specs, counts)])
    start = F.coalesce(*[F.when(F.col("spec_id") == spec, F.lit(k)) for (spec, _), k in zip(specs, starts)])
    second = open_again.select("spec_id", "key", "part", F.col("first_token").alias("first"), "tokens", "terms", "counts", (start + F.pmod(F.xxhash64("key", "part"), count)).cast("int").alias("shard"))

    def two(shard: int, table: pa.Table) -> pa.Table:
        spec = table.column("spec_id")[0].as_py()
        return emit(table, f"b{shard}", [(spec, capacities[spec])], False)

    repacked = by_shard(second, sum(counts), two)
    both = done.unionByName(repacked)
    return both.select("spec_id", "container", F.col("key").alias(key), "part", "first_token", "tokens")


def packing_report(packed: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """Per spec: containers used, the fewest that could hold the tokens, tokens, fill, the fullest container, documents,
    documents in several parts."""
    each = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("inside"))
    use = each.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("inside").alias("tokens"), F.max("inside").alias("fullest"))
    docs = packed.groupBy("spec_id", key).agg(F.max("part").alias("parts")).groupBy("spec_id").agg(F.count("*").alias("documents"), F.sum((F.col("parts") > 1).cast("int")).alias("split"))
    out = specs.select("spec_id", "capacity_tokens").join(use, "spec_id").join(docs, "spec_id")
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return out.select("spec_id", "capacity_tokens", "containers", least.alias("least_containers"), "tokens", F.round(F.col("tokens") / F.col("containers") / F.col("capacity_tokens"), 6).alias("fill"), "fullest", "documents", "split")
