"""Dense numbers and running totals over a whole table, by parts.

Rows are dealt by ranges of their order. Each partition counts and sums what it
holds, one row a partition meets in a window, and a row's number is its place in
its own partition after all earlier ones. No task holds more than a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def dense(rows: DataFrame, *order: str, number: str = "id", total: str | None = None, offset: str = "offset") -> DataFrame:
    """``rows`` with ``number``, 0, 1, ... in order, and ``offset``, the sum of
    the column ``total`` over all rows before, if one is named. Rows that tie
    in ``order`` are numbered in any order."""
    place = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    size = F.sum(F.col(total)) if total else F.count(F.lit(1))
    parts = place.groupBy(part).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"), size.alias("_sum"))
    # One row a partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_zero"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    out = place.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(parts), "_part").withColumn(number, F.col("_place") + F.col("_zero"))
    if total:
        local = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(offset, F.col("_before") + F.coalesce(F.sum(total).over(local), F.lit(0)))
    return out.drop("_part", "_place", "_zero", "_before")
