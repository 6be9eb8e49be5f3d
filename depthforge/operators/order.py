"""Order statistics, shuffles and samples of any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kth_smallest(df: DataFrame, value: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, kth): the ``k``-th smallest value (from 1, repeated ones count) of each group; a group with fewer values, nulls left out, has none.

    Values are counted before the shuffle and ranked by their counts, so no group is sorted row by row.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy(value)))
    return upto.filter(F.col("upto") >= k).groupBy(*by).agg(F.min(value).alias("kth")).filter("kth is not null")


def shuffled(df: DataFrame, seed: int = 11) -> DataFrame:
    """All rows in a random order, the same for the same seed and partitions."""
    return df.orderBy(F.rand(seed))


def sampled(df: DataFrame, rows: int, seed: int = 11) -> DataFrame:
    """``rows`` random rows without repetition (all, if there are fewer)."""
    return df.orderBy(F.rand(seed)).limit(rows)
