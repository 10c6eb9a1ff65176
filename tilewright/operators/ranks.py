"""Exact ranks over tables of any size, without a task that sees a whole group.

Rows are dealt to a fixed number of ranges by a distributed sort and written,
with their range's number and their place in it, to the shared folder.  Sizes of
ranges and rows then come from that one table: planning it twice would sample
other bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.shared import saved, scratch

#: Bits of ``monotonically_increasing_id`` that hold the place in a partition.
PLACE_BITS = 33


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` stored in the order of ``keys``, with ``__part`` and ``__place``."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    stored = saved(rows, scratch(spark, "dealt"))
    place = F.col("__id").bitwiseAND((1 << PLACE_BITS) - 1)
    return stored.select(*df.columns, F.shiftright("__id", PLACE_BITS).alias("__part"), place.alias("__place"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe inner join; ``right`` has the keys and columns of its own."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(r[f"__r_{k}"])
    return left.join(r, on).drop(*(f"__r_{k}" for k in keys))


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str = "rank", size: str | None = None) -> DataFrame:
    """Rows with their rank from 0 within ``by`` in the order of ``order``, and
    on demand their group's size.  Equal values are ranked in any order.

    The table of starts has a row for each range and group in it: no more than
    ranges and groups together.
    """
    dealt = _dealt(df, [*by, *order])
    sizes = dealt.groupBy(*by, "__part").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start"), F.sum("__n").over(group).alias("__size"))
    out = _joined(dealt, starts, [*by, "__part"]).withColumn(rank, F.col("__start") + F.col("__place"))
    if size:
        out = out.withColumn(size, F.col("__size"))
    return out.drop("__part", "__place", "__start", "__size")


def cumulated(counts: DataFrame, by: list[str], order: str, n: str = "n") -> DataFrame:
    """Distinct values of each group with ``before``, the sum of ``n`` over
    smaller ones, and ``total``, the group's sum.  A group may span all ranges."""
    dealt = _dealt(counts, [*by, order])
    sums = dealt.groupBy(*by, "__part").agg(F.sum(n).alias("__n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"), F.sum("__n").over(group).alias("total"))
    inside = Window.partitionBy(*by, "__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__own", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    out = _joined(own, starts, [*by, "__part"])
    return out.withColumn("before", F.col("__start") + F.col("__own")).drop("__part", "__place", "__start", "__own")
