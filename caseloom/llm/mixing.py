"""Mixing sources to target weights, block by block.

Each source's share of a mix is cut into blocks of equal size. As in Pfair scheduling, a source of weight w releases its
j-th block at slot floor(j / w) and its deadline is slot ceil((j + 1) / w); in every slot the released block with the
earliest deadline is taken. At every point of the mix each source is then less than one block off its share. Blocks are a
fixed number of parts of the mix, so the schedule's size is bounded however large the mix is; documents only look their
block's slot up.

The shares hold exactly up to half a document. A source that is too small for its share even when it is repeated as often
as allowed makes the whole mix smaller rather than the share wrong; a source of the targets without any tokens has nothing
to give, its weight goes to the others in proportion.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCKS = 2048
#: mix_targets is a table of settings; more rows than this are a mistake.
MAX_TARGETS = 10_000


@dataclass
class Part:
    mix_id: int
    source: str
    share: float
    max_repeats: int
    wanted: float  # tokens for the share at the size asked for
    goal: float  # tokens for the share at the size that can be reached
    supply: int  # tokens of the source, once


def schedule(weights: Sequence[float], blocks: int) -> list[int]:
    """For each slot the source that is served: earliest deadline first among the released blocks, ties by number."""
    left = [math.ceil(w * blocks - 1e-9) for w in weights]
    served = [0] * len(weights)
    out = []
    while any(s < n for s, n in zip(served, left)):
        t = len(out)
        ready = [i for i, w in enumerate(weights) if served[i] < left[i] and math.floor(served[i] / w + 1e-9) <= t]
        # rounding the last blocks up makes more blocks than slots: then whoever is next in time
        pick = ready or [i for i in range(len(weights)) if served[i] < left[i]]
        i = min(pick, key=lambda x: (math.ceil((served[x] + 1) / weights[x] - 1e-9), x))
        served[i] += 1
        out.append(i)
    return out


def plan(targets: Sequence[tuple], supply: dict[str, int], total: int) -> list[Part]:
    """The tokens that each source gives to each mix; targets: (mix_id, source, share, max_repeats, size_factor)."""
    out = []
    for mix in sorted({t[0] for t in targets}):
        rows = [t for t in targets if t[0] == mix]
        some = [t for t in rows if supply.get(t[1], 0) > 0 and (t[2] or 0) > 0 and (t[3] or 0) > 0]
        whole = sum(t[2] for t in some)
        size = rows[0][4] * total
        scale = min([1.0, *(supply[t[1]] * t[3] / (t[2] / whole * size) for t in some if size > 0)])
        for t in rows:
            share = t[2] / whole if t in some else 0.0
            out.append(Part(mix, t[1], t[2] or 0.0, t[3] or 0, (t[2] or 0.0) * size, share * size * scale, supply.get(t[1], 0)))
    return out


def mix_documents(sized: DataFrame, targets: DataFrame, key: str, blocks: int = BLOCKS, bucket_rows: int = 50_000) -> tuple[DataFrame, list[Part]]:
    """mix_id, slot, place, source, key, repeat, tokens: the documents of each mix in their order (slot, then place).

    sized: key, source, tokens. place is the document's first token in its source's stream. A document comes at most
    max_repeats times, all documents of a source once before any comes again. Documents without source or tokens are in no
    mix, but their tokens count for the mix's size. Also returns the plan.
    """
    spark = sized.sparkSession
    rows = [tuple(r) for r in targets.select("mix_id", "source", "share", "max_repeats", "size_factor").limit(MAX_TARGETS + 1).collect()]
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    named = sorted({r[1] for r in rows})
    sums = sized.groupBy(F.when(F.col("source").isin(named), F.col("source")).alias("source")).agg(F.sum("tokens"), F.count("*")).collect()  # a row per source of the targets
    supply = {r[0]: int(r[1] or 0) for r in sums if r[0] is not None}
    parts = plan(rows, supply, sum(int(r[1] or 0) for r in sums))
    # each document's place in its source's stream: sums of buckets first, then within the bucket
    buckets = max(1, sum(r[2] for r in sums) // bucket_rows)
    order = F.xxhash64(F.col(key), F.lit(7))
    docs = sized.where(F.col("source").isin(named) & (F.col("tokens") > 0)).select("source", F.col(key).alias("key"), "tokens", order.alias("order"), F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(buckets)).alias("bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("inside")).withColumn("start", F.coalesce(F.sum("inside").over(before), F.lit(0))).drop("inside")
    inner = Window.partitionBy("source", "bucket").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("inner", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(starts, ["source", "bucket"]).select("source", "key", "tokens", (F.col("start") + F.col("inner")).alias("place"))
    slots, settings = [], []
    for mix in sorted({p.mix_id for p in parts}):
        own = [p for p in parts if p.mix_id == mix and p.goal > 0]
        size = sum(p.goal for p in own)
        if not size:
            continue
        block = size / blocks
        at: dict[int, int] = {}
        for slot, i in enumerate(schedule([p.goal / size for p in own], blocks)):
            at[i] = at.get(i, -1) + 1
            slots.append((mix, own[i].source, at[i], slot))
        settings += [(mix, p.source, p.max_repeats, p.goal, p.supply, block, max(0, at[k])) for k, p in enumerate(own)]
    known = spark.createDataFrame(settings, "mix_id int, source string, max_repeats int, goal double, supply bigint, block double, last int")
    when = spark.createDataFrame(slots, "mix_id int, source string, j int, slot int")
    # both tables are bounded by the targets and the number of blocks
    use = placed.join(F.broadcast(known), "source")
    rounds = F.floor(F.col("goal") / F.col("supply"))
    rest = F.col("goal") - rounds * F.col("supply")
    times = F.least(F.col("max_repeats"), (rounds + F.when(F.col("place") + F.col("tokens") / 2 <= rest, 1).otherwise(0)).cast("int"))
    each = use.withColumn("times", times).where("times > 0").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("times"))))
    each = each.withColumn("place", F.col("place") + (F.col("repeat") - 1) * F.col("supply")).withColumn("j", F.least(F.floor(F.col("place") / F.col("block")).cast("int"), F.col("last")))
    out = each.join(F.broadcast(when), ["mix_id", "source", "j"])
    return out.select("mix_id", "slot", "place", "source", F.col("key").alias(key), "repeat", "tokens"), parts


def shares_reached(mixed: DataFrame, parts: Sequence[Part], key: str) -> DataFrame:
    """Per mix and source: the target share and the share reached, tokens wanted at the size asked for, at the size that can be
    reached (goal) and given, documents, the largest of them, the most uses of one."""
    spark = mixed.sparkSession
    use = mixed.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.sum((F.col("repeat") == 1).cast("int")).alias("documents"), F.max("repeat").alias("most_uses"), F.max("tokens").alias("largest"))
    goal = spark.createDataFrame([(p.mix_id, p.source, p.share, p.max_repeats, p.wanted, p.goal, p.supply) for p in parts], "mix_id int, source string, target_share double, max_repeats int, wanted_tokens double, goal_tokens double, source_tokens bigint")
    both = F.broadcast(goal).join(use, ["mix_id", "source"], "left")
    tokens = F.coalesce("tokens", F.lit(0))
    whole = F.sum(tokens).over(Window.partitionBy("mix_id"))
    return both.select("mix_id", "source", "target_share", F.round(tokens / F.when(whole > 0, whole), 6).alias("share"), F.round("wanted_tokens", 1).alias("wanted_tokens"), F.round("goal_tokens", 1).alias("goal_tokens"), tokens.alias("tokens"), "source_tokens", F.coalesce("documents", F.lit(0)).alias("documents"), "max_repeats", F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "largest")


def running_deviation(mixed: DataFrame, parts: Sequence[Part], blocks: int = BLOCKS) -> DataFrame:
    """Per mix and source: the largest deviation of its tokens from its share of the blocks so far, at the ends of the slots,
    and its bound, a block and the largest document of the mix.

    Tokens are summed by slot and source first: at most `blocks` times the sources, whatever the number of documents.
    """
    spark = mixed.sparkSession
    size: dict[int, float] = {}
    for p in parts:
        size[p.mix_id] = size.get(p.mix_id, 0.0) + p.goal
    known = spark.createDataFrame([(p.mix_id, p.source, p.goal / size[p.mix_id], size[p.mix_id] / blocks) for p in parts if p.goal > 0], "mix_id int, source string, part double, block double")
    each = mixed.groupBy("mix_id", "slot", "source").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))
    slots = each.groupBy("mix_id", "slot").agg(F.max("longest").alias("longest")).withColumn("longest", F.max("longest").over(Window.partitionBy("mix_id")))
    # every source at the end of every slot, also of those that others had
    grid = slots.join(F.broadcast(known), "mix_id").join(each.drop("longest"), ["mix_id", "slot", "source"], "left")
    own = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix_id", "source").orderBy("slot"))
    gaps = grid.select("mix_id", "source", F.abs(own - F.col("part") * (F.col("slot") + 1) * F.col("block")).alias("gap"), (F.col("block") + F.col("longest")).alias("most"))
    return gaps.groupBy("mix_id", "source").agg(F.max("gap").alias("deviation"), F.max("most").alias("bound"))
