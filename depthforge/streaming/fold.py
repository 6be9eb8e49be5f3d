"""Micro-batch folding of partial histograms.

Flag counters and histograms of insert sizes are sums, so a file stream of reads can be folded
batch by batch: each batch appends its partial histogram under its number, and the result is the sum of
the parts. A batch that is run again overwrites its own part, so every read counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reads import flagstat, insert_sizes


def _fold(reads: DataFrame, path: str, checkpoint: str, partial: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    def put(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_insert_sizes(reads: DataFrame, path: str, checkpoint: str, limit: int = 2000) -> StreamingQuery:
    """Start a stream that folds the insert sizes of ``reads`` (a streaming DataFrame) into parts below ``path``."""
    return _fold(reads, path, checkpoint, lambda batch: insert_sizes(batch, limit))


def fold_counters(reads: DataFrame, path: str, checkpoint: str, min_mapq: int = 20) -> StreamingQuery:
    """Start a stream that folds the flag counters of ``reads`` into parts below ``path``."""
    return _fold(reads, path, checkpoint, lambda batch: flagstat(batch, min_mapq))


def folded(spark: SparkSession, path: str) -> DataFrame:
    """The histogram of all batches."""
    return spark.read.parquet(path).groupBy("value").agg(F.sum("cnt").cast("bigint").alias("cnt"))


def folded_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters of all batches, in one row."""
    parts = spark.read.parquet(path).drop("batch")
    return parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in parts.columns))
