"""Global row positions (O4, J3) without a window over all rows.

``ROW_NUMBER() OVER ()`` and a concat by position number rows over the whole
table. A window without partitions would bring every row to one task; here
rows are sorted by range over all partitions, counted inside each, and the
counts of the partitions before are added. Only those counts, one a
partition, are looked at together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def numbered(df: DataFrame, *order: str | Column, column: str = "position") -> DataFrame:
    """Adds each row's position from 1 on, in the order of ``order`` or, without, of the source's rows.

    Rows equal in ``order`` get different positions in no particular order, for good: the numbered
    table is settled first, so that a task that runs again can't number them otherwise.
    """
    if order:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = settled(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # one row a partition, hence the broadcast
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.join(F.broadcast(offsets), part == F.col("_part"))
    return joined.withColumn(column, F.col("_before") + at + 1).drop("_at", "_part", "_n", "_before")


def concat_by_position(left: DataFrame, right: DataFrame, left_order: tuple = (), right_order: tuple = (), how: str = "full") -> DataFrame:
    """J3 by position: the n-th row of one frame beside the n-th row of the other, nulls where one is shorter."""
    return numbered(left, *left_order).join(numbered(right, *right_order), "position", how)
