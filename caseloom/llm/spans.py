"""Long exact spans shared between records.

Content-defined chunking with a gear rolling hash: the hash at a byte depends on the WINDOW bytes up to it; a chunk
boundary is a byte whose hash is the least of some SPREAD consecutive ones (the last of equals), so boundaries follow the
content and resist insertions. Every run of 2 * SPREAD + WINDOW - 1 common bytes holds two boundaries that both records
share, so it holds a whole common chunk; with 200 characters and SPREAD 84 no pair is missed. Chunks are deduplicated by
digest, records that share one are compared exactly.

A digest that many records share (a stock phrase shorter than the spans asked for) would give pairs that fail the exact
comparison. Such chunks go another, equally exact way: they are extended by context on either side, in the end to whole
ranges of the length asked for, so only records that really share a span meet.

Exact copies are one class: links are found between the classes' first records only, membership tells the rest (`all_pairs`
expands both where every pair is wanted).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.dedupe import latest_by
from ..plans.session import cut_lineage

#: Bytes the rolling hash looks back; 32 bits shift a byte out after 32 steps.
WINDOW = 32

_rng = np.random.default_rng(20260101)
GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]], for all i at once by doubling the window."""
    h, span = GEAR[data], 1
    while span < WINDOW:
        before = np.zeros_like(h)
        before[span:] = h[:-span]
        h = h + (before << np.uint32(span))
        span *= 2
    return h


def boundaries(data: np.ndarray, spread: int) -> np.ndarray:
    """Places that hold the least hash (the last of equals) of some `spread` consecutive places."""
    n = len(data)
    if n < spread:
        return np.zeros(0, np.int64)
    key = (gear_hash(data).astype(np.uint64) << np.uint64(32)) | np.arange(n, 0, -1, dtype=np.uint64)
    low, span = key, 1
    while span * 2 <= spread:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    rest = spread - span
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    keep = np.ones(len(low), bool)
    keep[1:] = low[1:] != low[:-1]
    at = n - (low[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.unique(at)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(p, dtype=np.uint64)


def range_digests(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of codes[start:end], equal for equal contents wherever they stand."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _powers(len(codes), BASE), out=total[1:])
        out = (total[end] - total[start]) * _powers(len(codes) + 1, INVERSE)[start]
        out = out * np.uint64(0xBF58476D1CE4E5B9) + (end - start).astype(np.uint64)
        return out ^ (out >> np.uint64(31))


CHUNKS = "rec string, digest bigint, pos int, len int"


def chunk_table(records: DataFrame, rec: str, text: str, min_chars: int) -> DataFrame:
    """rec, digest, pos, len: the chunks of each record's text with the hash's window before them; places in bytes."""
    spread = (min_chars - WINDOW) // 2

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # slices bound the memory when texts are long
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                arr = b.column(1).cast(pa.large_string())
                off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
                if arr.buffers()[2] is None or off[-1] == off[0]:
                    continue
                data = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]]
                off = off - off[0]
                cut = boundaries(data, spread)
                if len(cut) < 2:
                    continue
                start, end = cut[:-1] - (WINDOW - 1), cut[1:] + 1
                row = np.searchsorted(off, cut[:-1], side="right") - 1
                inside = (start >= off[row]) & (end <= off[row + 1])
                start, end, row = start[inside], end[inside], row[inside]
                digest = range_digests(BYTE[data], start, end).view(np.int64)
                cols = [b.column(0).take(pa.array(row)), pa.array(digest), pa.array((start - off[row]).astype(np.int32)), pa.array((end - start).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["rec", "digest", "pos", "len"])

    long = records.where(F.length(text) >= min_chars).select(F.col(rec).alias("rec"), F.col(text).alias("text"))
    return long.mapInArrow(chunks, CHUNKS)


def _around(min_chars: int, sides: bool):
    """Keys of longer ranges around chunks, from rows of rec, text and places (array of pos, len).

    sides: two keys a chunk, it with half of what is missing to min_chars before it, and with half after it: a span of
    min_chars bytes around the chunk holds one of the two. Else the keys of all ranges of min_chars bytes that hold it.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rec, text, places in zip(*(b.column(i).to_pylist() for i in range(3))):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                at = np.array([(x["pos"], x["len"]) for x in places], np.int64).reshape(-1, 2)
                pos, end = at[:, 0], at[:, 0] + at[:, 1]
                if sides:
                    more = -(-np.maximum(0, min_chars - at[:, 1]) // 2)
                    start, stop = np.concatenate([pos - more, pos]), np.concatenate([end, end + more])
                else:
                    begin = [np.arange(max(0, e - min_chars), min(p, len(data) - min_chars) + 1) for p, e in zip(pos, end)]
                    start = np.unique(np.concatenate([*begin, np.zeros(0, np.int64)]))
                    pos, end, stop = start, start, start + min_chars
                fits = (start >= 0) & (stop <= len(data))
                origin = np.concatenate([at, at])[fits] if sides else np.stack([start, stop - start], 1)[fits]
                key = range_digests(BYTE[data], start[fits], stop[fits]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([rec] * len(key), pa.string()), pa.array(key), pa.array(origin[:, 0].astype(np.int32)), pa.array(origin[:, 1].astype(np.int32))], ["rec", "digest", "pos", "len"])

    return emit


def _windows(text: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and the digests of all windows of `length` characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - length + 1
    if n <= 0:
        return codes, np.zeros(0, np.uint64)
    start = np.arange(n)
    mixed = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return codes, range_digests(mixed ^ (mixed >> np.uint64(29)), start, start + length)


def common_spans(a: str, b: str, length: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The parts of a, and of b, covered by spans of at least `length` characters that both have; merged, [start, end)."""
    # a span of `length` holds a whole block at a multiple of half of it: most pairs end here
    half = length // 2
    if not any(a[i : i + half] in b for i in range(0, len(a) - half + 1, half)):
        return [], []
    ca, ha = _windows(a, length)
    cb, hb = _windows(b, length)

    def covered(codes: np.ndarray, own: np.ndarray, other: np.ndarray, text: str, against: str) -> list[tuple[int, int]]:
        hit = np.flatnonzero(np.isin(own, other))
        out: list[tuple[int, int]] = []
        for i in hit.tolist():
            # digests of neighbours in a run confirm each other; a run's first and last window are compared exactly
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + length)
            else:
                out.append((i, i + length))
        return [(s, e) for s, e in out if text[s : s + length] in against and text[e - length : e] in against]

    return covered(ca, ha, hb, a, b), covered(cb, hb, ha, b, a)


LINKS = "rec_a string, rec_b string, spans_a array<struct<s:int,e:int>>, spans_b array<struct<s:int,e:int>>"


def _repeated(chunks: DataFrame) -> DataFrame:
    """Chunks whose digest more than one record has, with `recs`, the number of rows of the digest (one more than that of its
    records where a record repeats it)."""
    counts = chunks.groupBy("digest").agg(F.count("*").alias("recs")).where("recs > 1")
    return chunks.join(counts, "digest")


def _pairs(chunks: DataFrame, hot: int) -> DataFrame:
    """rec_a, rec_b of digests with at most `hot` rows."""
    groups = chunks.where(F.col("recs") <= hot).groupBy("digest").agg(F.array_sort(F.collect_set("rec")).alias("r")).where(F.size("r") > 1)
    each = F.transform(F.sequence(F.lit(0), F.size("r") - 2), lambda k: F.transform(F.slice("r", k + 2, F.lit(hot)), lambda other: F.struct(F.get("r", k).alias("rec_a"), other.alias("rec_b"))))
    return groups.select(F.inline(F.flatten(each))).distinct()


def shared_spans(records: DataFrame, rec: str = "rec", text: str = "text", version: str | None = None, min_chars: int = 200, hot: int = 4) -> tuple[DataFrame, DataFrame]:
    """Links and membership of records that share at least min_chars consecutive characters.

    Links: rec_a, rec_b, spans_a, spans_b, every pair of different texts, each under the least name of its copies.
    Membership: rec, rep, n_chars, every record that may share something with the first record of its copies.

    records: one row per record, or several of which the one with the greatest `version` counts; texts may be NULL, empty,
    equal or very long. rec_a < rec_b; spans are the parts of each text, merged, that lie in spans of at least min_chars
    shared by the two. min_chars must be 96 at least. hot: a digest with more rows than this gives no pairs itself; its
    chunks are extended to half of the missing context on either side, and if that still is as common, to all ranges of
    min_chars bytes around them. Every way is exact, so `hot` only sets the costs. A pair comes out once. The number of
    links between different texts is the result's own size, whatever it is.
    """
    if min_chars < 3 * WINDOW:
        raise ValueError(f"min_chars must be {3 * WINDOW} at least")
    texts = records.where(F.length(text) >= min_chars).select(F.col(rec).alias("rec"), F.col(text).alias("text"), (F.col(version) if version else F.lit(None).cast("timestamp")).alias("version"))
    shared = cut_lineage(_repeated(cut_lineage(chunk_table(texts, "rec", "text", min_chars))))
    involved = shared.select("rec").distinct()
    texts = texts.join(involved, "rec", "left_semi")
    texts = cut_lineage(latest_by(texts, ["rec"], "version", ["text"]) if version else texts.drop("version"))

    copies = texts.select("rec", F.md5("text").alias("copy"), F.length("text").alias("n_chars"))
    first = copies.groupBy("copy").agg(F.min("rec").alias("rep"))
    members = cut_lineage(copies.join(first.hint("merge"), "copy").select("rec", "rep", "n_chars"))
    shared = cut_lineage(_repeated(shared.drop("recs").join(members.where("rec = rep").select("rec").hint("merge"), "rec", "left_semi")))

    def wider(chunks: DataFrame, sides: bool) -> DataFrame:
        places = chunks.groupBy("rec").agg(F.collect_set(F.struct("pos", "len")).alias("places"))
        return texts.join(places, "rec").select("rec", "text", "places").mapInArrow(_around(min_chars, sides), CHUNKS)

    sided = cut_lineage(_repeated(cut_lineage(wider(shared.where(F.col("recs") > hot), True))))
    crowd = cut_lineage(wider(sided.where(F.col("recs") > hot), False).select("rec", "digest").distinct())
    again = crowd.groupBy("digest").count().where("count > 1").drop("count")
    crowd = crowd.join(again, "digest")
    far = crowd.withColumnRenamed("rec", "rec_a").join(crowd.withColumnRenamed("rec", "rec_b"), "digest").where("rec_a < rec_b").select("rec_a", "rec_b")
    candidates = _pairs(shared, hot).unionByName(_pairs(sided, hot)).unionByName(far).distinct()
    found = candidates.join(texts.select(F.col("rec").alias("rec_a"), F.col("text").alias("text_a")), "rec_a").join(texts.select(F.col("rec").alias("rec_b"), F.col("text").alias("text_b")), "rec_b")
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, left, right = [], [], []
            for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                sa, sb = common_spans(x, y, min_chars)
                if sa and sb:
                    keep.append(k)
                    left.append([{"s": s, "e": e} for s, e in sa])
                    right.append([{"s": s, "e": e} for s, e in sb])
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(left, span), pa.array(right, span)], ["rec_a", "rec_b", "spans_a", "spans_b"])

    return found.select("rec_a", "rec_b", "text_a", "text_b").mapInArrow(verify, LINKS), members


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """rec_a, rec_b: every pair of records behind links and membership, copies of each other too; rec_a < rec_b.

    As many rows as there are pairs: where a text has a million copies, take links and membership instead.
    """
    one = lambda side: members.select(F.col("rep").alias(f"rec_{side}"), F.col("rec").alias(side))
    across = links.select("rec_a", "rec_b").join(one("a").hint("merge"), "rec_a").join(one("b").hint("merge"), "rec_b").select("a", "b")
    same = one("a").join(one("b").withColumnRenamed("rec_b", "rec_a").hint("merge"), "rec_a").where("a < b").select("a", "b")
    return across.unionByName(same).select(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b"))


def shared_shares(records: DataFrame, links: DataFrame, members: DataFrame, rec: str = "rec", text: str = "text") -> DataFrame:
    """rec, n_chars, shared_chars, share, partners: of every record, how much of its text lies in spans shared elsewhere.

    Made of links and membership without expanding pairs: a record with copies is shared as a whole, and a link counts all
    copies of its other side. Records without shared spans come out with 0; a NULL text has NULL in n_chars and share.
    """
    size = members.groupBy("rep").agg(F.count("*").alias("copies"))
    flat = cut_lineage(links.select(F.col("rec_a").alias("rep"), F.col("rec_b").alias("other"), F.inline("spans_a")).unionByName(links.select(F.col("rec_b").alias("rep"), F.col("rec_a").alias("other"), F.inline("spans_b"))))
    spans = flat.groupBy("rep", "s", "e").agg(F.count("*").alias("n"))
    before = F.max("e").over(Window.partitionBy("rep").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(before, F.lit(0))))
    length = spans.withColumn("fresh", fresh).groupBy("rep").agg(F.sum("fresh").cast("int").alias("fresh"))
    others = flat.select("rep", "other").distinct().join(size.select(F.col("rep").alias("other"), F.col("copies").alias("c")).hint("merge"), "other").groupBy("rep").agg(F.sum("c").alias("others"))
    classes = size.join(length.hint("merge"), "rep", "left").join(others.hint("merge"), "rep", "left")
    told = members.drop("n_chars").join(classes.hint("merge"), "rep").drop("rep")
    out = records.select(F.col(rec).alias("rec"), F.length(text).alias("n_chars")).join(told.hint("merge"), "rec", "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("fresh", F.lit(0)))
    partners = F.coalesce("others", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select("rec", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).alias("share"), partners.alias("partners"))
