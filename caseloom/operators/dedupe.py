"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map of keys that come more than once, in pages of PAGE bits: 512 rows of 4 KB, 2 MB, whatever the table. It
#: keeps nine rows in ten from the shuffle up to some two million such keys; 1 << 27 (16 MB) does up to 14 million.
BITS, PAGE = 1 << 24, 1 << 15


def _place(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def _rank(order: str) -> Column:
    return F.coalesce(F.col(order).cast("timestamp").cast("double"), F.lit(float("-inf")))


def latest_by(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str] | None = None, wide: bool = False) -> DataFrame:
    """The row with the greatest `order` of each key.

    Rows whose `order` is NULL lose against any other row; among equal rows any one is kept (they are interchangeable when
    rows are only loaded twice). Rows with a NULL key form one group. `columns` names the columns to keep besides the keys;
    all others when it is None. An empty table gives an empty table.

    wide: for rows that are costly to shuffle and seldom repeated. The keys alone are counted first; those that come more than
    once set a bit in a map of fixed size, which is broadcast. Rows whose bit isn't set are passed on as they are, only the
    others are shuffled (a bit that is set by chance costs a shuffled row, never a wrong one). The table is read twice more.
    """
    keep = [c for c in (columns or df.columns) if c not in keys]
    unpacked = [*keys, *[F.col(f"__row.`{c}`").alias(c) for c in keep]]
    if not wide:
        return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), _rank(order)).alias("__row")).select(*unpacked)
    again = df.select(*keys).groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(_place(keys).alias("__at"))
    pages = again.groupBy(F.floor(F.col("__at") / PAGE).alias("__page")).agg(F.bitmap_construct_agg(F.col("__at") % PAGE).alias("__bits"))
    at = _place(keys)
    placed = df.select(*keys, *{*keep, order} - {*keys}, F.floor(at / PAGE).alias("__page"), (at % PAGE).cast("int").alias("__bit"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    told = placed.join(F.broadcast(pages), "__page", "left").withColumn("__twice", F.coalesce(F.getbit(byte.cast("bigint"), F.col("__bit") % 8) == 1, F.lit(False)))
    several = told.where("__twice").groupBy(*keys).agg(F.max_by(F.struct(*keep), _rank(order)).alias("__row")).select(*unpacked)
    return told.where("not __twice").select(*keys, *keep).unionByName(several)
