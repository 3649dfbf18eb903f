"""Numbering rows in an order without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.session import cut_lineage


def numbered(df: DataFrame, order: Sequence[str], name: str, per: Sequence[str] = ()) -> DataFrame:
    """df with `name`: each row's place (from 1) in the order, counted within the groups of `per`.

    Rows are split into ranges of (per, order), so a large group spreads over many tasks; the counts of the ranges before, a
    row per range and group, give each range its first number. Rows that are equal in per and order are numbered in any
    order. The ranged rows are written once, so both steps see the same ranges.
    """
    ranged = cut_lineage(df.repartitionByRange(*per, *order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy(*per, "__range").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*per).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*per, "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy(*per, "__range").orderBy(*order)
    joined = ranged.withColumn("__in", F.row_number().over(own))
    same = [joined[c].eqNullSafe(starts[c]) for c in (*per, "__range")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return joined.join(starts, on).select(*[joined[c] for c in df.columns], (F.col("__start") + F.col("__in")).alias(name))
