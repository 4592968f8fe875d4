"""Positions in an order within large groups.

``row_number`` over a group puts the group into one task.  Here rows are dealt
into ranges of the whole order (Spark samples the bounds, so ranges hold equally
many rows whatever the values are) and numbered within each range; what stands
before a range is a prefix sum over one count per range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkaudit.session import checkpointed, written

#: Ranges of groups (a key, two longs) that may be broadcast.
BROADCAST_RANGES = 200_000


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` sorted over range partitions, written once: ``_range`` numbers the partition, ``_at`` rises within it.

    A row's number is the last sorting column, so rows that agree in ``order`` don't stick to one range.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, "_row"]
    return written(
        df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).drop("_row"))


def with_position(df: DataFrame, name: str, group: list[str], fine: str, lead: Column | None = None,
                  ties: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with the 1-based position ``name`` within ``group``, ordered by ``lead`` (ascending, if
    given), ``fine`` and ``ties``, nulls first.  Rows that agree in all of them get positions in some
    order and may lie in several ranges.  ``df`` is computed once: it is written before the bounds are sampled."""
    once = written(df.withColumn("_lead", lead if lead is not None else F.lit(0)))
    ordered = in_ranges(once, [*group, "_lead", fine, *ties], ranges)
    key = [*group, "_range"]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ordered.groupBy(*key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    firsts = checkpointed(firsts)
    if firsts.count() <= BROADCAST_RANGES:  # the rows stay where they are
        firsts = F.broadcast(firsts)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    joined = ordered.alias("l").join(firsts.alias("r"), same).select("l.*", "_first", "_before")
    return joined.withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long")).drop(
        "_lead", "_range", "_at", "_first", "_before")
