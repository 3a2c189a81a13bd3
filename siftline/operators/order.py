"""Places in one order over all rows, found in parallel.

Rows are dealt by ranges of the order and sorted within each; ranges are
summed up, and the sums of the ranges before are added to those within. Nothing
but one row for each range comes together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.shared import stored


def running_totals(rows: DataFrame, *order: str | Column, **weights: Column) -> DataFrame:
    """Add, for each name of ``weights``, the sum of that column over all
    earlier rows. ``order`` should tell all rows apart; equal rows come in any order."""
    dealt = rows.withColumns(weights).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # rises with the row within each partition
    placed = stored(dealt.withColumns({"__range": F.spark_partition_id(), "__place": place}), "ranges")
    within = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sums = placed.groupBy("__range").agg(*(F.sum(w).alias(f"__{w}") for w in weights))
    sums = sums.select("__range", *(zero(F.sum(f"__{w}").over(before)).alias(f"__{w}") for w in weights))  # one row for each range
    own = placed.withColumns({w: zero(F.sum(w).over(within)) for w in weights})
    out = own.join(F.broadcast(sums), "__range")
    return out.withColumns({w: (F.col(w) + F.col(f"__{w}")).cast("long") for w in weights}).drop("__range", "__place", *(f"__{w}" for w in weights))


def global_rank(rows: DataFrame, *order: str | Column, name: str = "nth") -> DataFrame:
    """Add the place, from 1, of each row in ``order`` over all rows."""
    return running_totals(rows, *order, **{name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + 1)
