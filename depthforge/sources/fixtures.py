"""Reads, targets and contigs derived from the driver's tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cigar import CIGAR

#: The same text runs in Spark and in DuckDB.
READS_COLUMNS = """'chr' || CAST(l_suppkey % 5 AS STRING) AS chrom
CAST((l_partkey*97 + l_linenumber*131 + l_orderkey) % 20000 AS INT) AS pos
CAST((CASE WHEN l_linenumber<>7 THEN 1 ELSE 0 END) + (CASE WHEN l_linestatus='F' AND l_linenumber<>7 THEN 2 ELSE 0 END) + (CASE WHEN l_orderkey%50=0 THEN 4 ELSE 0 END) + (CASE WHEN l_orderkey%40=1 AND l_linenumber<>7 THEN 8 ELSE 0 END) + (CASE WHEN l_returnflag='R' THEN 16 ELSE 0 END) + (CASE WHEN l_linenumber=7 THEN 0 WHEN l_linenumber%2=1 THEN 64 ELSE 128 END) + (CASE WHEN l_partkey%33=0 THEN 256 ELSE 0 END) + (CASE WHEN l_partkey%29=0 THEN 512 ELSE 0 END) + (CASE WHEN l_returnflag='A' AND l_linenumber=2 THEN 1024 ELSE 0 END) + (CASE WHEN l_partkey%41=0 THEN 2048 ELSE 0 END) AS INT) AS flag
CAST(round(l_discount*100) AS INT)*6 AS mapq
20 + CAST(l_quantity AS INT)%30 AS m1
CASE WHEN l_linenumber=3 THEN 4 ELSE 0 END AS d
CASE WHEN l_linenumber=6 THEN 50 ELSE 0 END AS n
30 AS m2
50 + CAST(l_quantity AS INT)%30 AS l_qseq
'chr' || CAST((CASE WHEN l_orderkey%60=2 THEN l_suppkey+1 ELSE l_suppkey END) % 5 AS STRING) AS mchrom
CAST(CASE WHEN l_linenumber=7 THEN 0 WHEN l_linenumber%2=1 THEN l_orderkey%2500 ELSE -(l_orderkey%2500) END AS INT) AS isize""".split("\n")
TARGET_COLUMNS = ["'chr' || CAST(p_partkey % 7 AS STRING) AS chrom", "CAST((p_partkey*613)%19000 AS INT) AS beg", "CAST((p_partkey*613)%19000 + 20 + p_size*2 AS INT) AS end_"]
#: A second set of intervals of the same rows.
OTHER_COLUMNS = ["'chr' || CAST(p_partkey % 6 AS STRING) AS chrom", "CAST((p_partkey*1009 + 77)%19500 AS INT) AS beg", "CAST((p_partkey*1009 + 77)%19500 + 10 + p_size AS INT) AS end_"]
CONTIG_LENGTH = 25_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer splits than cores; a large table has more, and stays as it is.

    A small file may be one row group, which one task reads however many splits there are; one that
    fills a single split is not worth a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 < df.rdd.getNumPartitions() < cores else df


def load_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).selectExpr(*READS_COLUMNS)
    op = lambda kind, length: F.when(F.col(length) > 0, F.array(F.struct(F.lit(kind).alias("op"), F.col(length).alias("len")))).otherwise(F.array()).cast(CIGAR)
    cigar = F.concat(op("M", "m1"), op("D", "d"), op("N", "n"), op("M", "m2"))
    return rows.withColumn("cigar", cigar).drop("m1", "d", "n", "m2")


def load_targets(spark: SparkSession, sf_dir: str, columns: list[str] = TARGET_COLUMNS) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*columns)


def load_contigs(spark: SparkSession) -> DataFrame:
    return spark.range(7).select(F.col("id").cast("int").alias("tid"), F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.lit(CONTIG_LENGTH).alias("length"))
