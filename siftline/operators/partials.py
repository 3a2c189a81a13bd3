"""Breakdowns of corpora that grow: partial tables that can be merged.

A batch gives counts and exact sums by key. Partial tables of any batches,
merged in any order, give what the whole corpus would. A batch's table has one
row for each key, whatever the batch's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partial(rows: DataFrame, keys: list[str], measure: str | None = None) -> DataFrame:
    """keys, n, total: counts and the sum of ``measure`` (0 without one, nulls
    left out), exact to six places."""
    total = F.sum(F.col(measure).cast("decimal(28,6)")) if measure else F.lit(None)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(total, F.lit(0)).cast("decimal(38,6)").alias("total"))


def merged(*parts: DataFrame) -> DataFrame:
    """One partial table of several."""
    both = reduce(DataFrame.unionByName, parts)
    keys = [c for c in both.columns if c not in ("n", "total")]
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,6)").alias("total"))


def finished(part: DataFrame, n: str = "n", average: str | None = None) -> DataFrame:
    """keys, the count as ``n``, and the mean of the measure as ``average``."""
    keys = [c for c in part.columns if c not in ("n", "total")]
    mean = [F.round(F.col("total").cast("double") / F.col("n"), 6).alias(average)] if average else []
    return part.select(*keys, F.col("n").alias(n), *mean)


def add_batch(part: DataFrame, path: str, batch: str) -> None:
    """Keep a batch's partial table. A batch that is added again replaces what it gave before."""
    part.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def all_batches(spark: SparkSession, path: str) -> DataFrame:
    """The merged table of all batches kept."""
    return merged(spark.read.parquet(path).drop("batch"))
