"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit in memory, by a seeded hash, and writes them.
Pass two shuffles each bucket in memory (Fisher-Yates with a generator seeded by the bucket) and
writes it. The buckets in a row are the shuffled order of the whole table; shards are equal
stretches of it, so the counts of two shards are at most one apart (law ``rows``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fresh_path, materialize
from .workers import tidy

#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 32 << 20
#: Tasks of the second pass, at most; with more buckets, a task shuffles several, one after the other.
MOST_TASKS = 50_000


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1; Generator.permutation runs the Fisher-Yates exchange."""
    return rng.permutation(n)


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 7, path: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all rows in shuffled order into ``n_shards`` shards and return what was written.

    Writes Parquet files ``shard=<k>/`` below ``path`` (by default in the shared folder), in the
    order of their slots, and returns a DataFrame over them: doc_id, text, ``slot`` (from 0,
    gapless in each shard) and ``shard``. Shard ``k`` has the rows of ranks
    ``[ceil(k*N/n), ceil((k+1)*N/n))``; their counts are at most one apart.

    The bucket of a row follows from the seed, its doc_id, its text and the partition it is read in, so a
    lost task is made anew with the same rows, and equal rows of many partitions fill no single bucket.
    The same input in the same partitions gives the same shards. Rows of one bucket are first put in the
    order of doc_id and text. Repeated rows are kept; which of two equal rows comes first cannot be told. Null doc_ids and
    null texts are kept as nulls. Other columns of ``docs`` are ignored. An empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    bound_batches(spark)
    scattered = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", F.spark_partition_id()), F.lit(buckets))), "scattered")
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    # one row for each bucket: a window over a table that is smaller than the data by the bucket's size
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("at", T.LongType())])

    def exchange(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        rng = np.random.default_rng([seed, table.column("bucket")[0].as_py()])
        out = table.take(pa.array(fisher_yates(table.num_rows, rng)))
        return out.append_column("at", pa.array(np.arange(table.num_rows, dtype=np.int64)))

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("bucket").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held[-1].column("bucket")[0].as_py() != bucket[a]:
                    yield from exchange(held).to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from exchange(held).to_batches()

    # a task for each bucket, whatever the data's size; sorting spills, and a worker holds one bucket
    tasks = min(buckets, MOST_TASKS)
    dealt = scattered.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket", "doc_id", "text")
    shuffled = dealt.select("doc_id", "text", "bucket").mapInArrow(tidy(shuffle), schema).join(F.broadcast(bases) if buckets <= 100_000 else bases, "bucket")
    rank = F.col("base") + F.col("at")
    # rank r lies in shard floor(r*n/N); the shard begins at ceil(shard*N/n)
    shard = F.expr(f"cast((base + at) * {n_shards} div {max(total, 1)} as int)")
    begin = F.expr(f"(cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")
    out = shuffled.withColumn("shard", shard).withColumn("slot", rank - begin).select("doc_id", "text", "slot", "shard")
    path = path or fresh_path(spark, "shards")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
