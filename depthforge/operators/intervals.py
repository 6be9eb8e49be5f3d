"""Interval algebra over (chrom, beg, end_), half-open and 0-based.

Everything runs on one sweep: intervals are cut at the edges of fixed-width bins, their ends become
events, and a cumulative sum per (chrom, bin) gives disjoint runs. So no window ever holds a whole
chromosome; only pieces that touch a bin's edge are joined across bins afterwards, and there
are at most two of these for each bin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: log2 of the bin width.
BIN_BITS = 14


def cut(df: DataFrame, keep: list[str], bits: int = BIN_BITS) -> DataFrame:
    """(chrom, bin, lo, hi, ``keep``) pieces of the intervals inside each bin; empty intervals have none."""
    at = df.filter("end_ > beg").withColumn("bin", F.explode(F.sequence(F.shiftright("beg", bits), F.shiftright(F.col("end_") - 1, bits))))
    return at.select("chrom", "bin", F.greatest("beg", F.shiftleft("bin", bits)).alias("lo"), F.least("end_", F.shiftleft(F.col("bin") + 1, bits)).alias("hi"), *keep)


def sweep(pieces: DataFrame, measures: list[str]) -> DataFrame:
    """Disjoint runs (chrom, bin, lo, hi, measures) with the sum of each measure over the pieces that cover them.

    Equal events are summed before the shuffle; a bin's runs end at its last event.
    """
    events = pieces.select("chrom", "bin", F.explode(F.array(F.struct(F.col("lo").alias("p"), *(F.col(m).cast("bigint").alias(m) for m in measures)), F.struct(F.col("hi").alias("p"), *((-F.col(m)).cast("bigint").alias(m) for m in measures)))).alias("e"))
    summed = events.groupBy("chrom", "bin", F.col("e.p").alias("p")).agg(*(F.sum(f"e.{m}").alias(m) for m in measures))
    order = Window.partitionBy("chrom", "bin").orderBy("p")
    runs = summed.select("chrom", "bin", F.col("p").alias("lo"), F.lead("p").over(order).alias("hi"), *(F.sum(m).over(order).alias(m) for m in measures))
    return runs.filter("hi is not null")


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Join abutting disjoint pieces (lo, hi) of each key."""
    order = Window.partitionBy(*keys).orderBy("lo")
    marked = df.withColumn("new", F.when(F.col("lo") > F.coalesce(F.lag("hi").over(order), F.lit(-1)), 1).otherwise(0))
    grouped = marked.withColumn("island", F.sum("new").over(order))
    return grouped.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def stitch(pieces: DataFrame, bits: int = BIN_BITS) -> DataFrame:
    """Intervals (chrom, beg, end_) of disjoint pieces (chrom, bin, lo, hi), abutting ones joined."""
    local = _islands(pieces.select("chrom", "bin", "lo", "hi"), ["chrom", "bin"])
    edge = (F.col("lo") == F.shiftleft("bin", bits)) | (F.col("hi") == F.shiftleft(F.col("bin") + 1, bits))
    inner = local.filter(~edge).select("chrom", "lo", "hi")
    crossing = _islands(local.filter(edge).select("chrom", "lo", "hi"), ["chrom"])
    return inner.unionByName(crossing).select("chrom", F.col("lo").cast("int").alias("beg"), F.col("hi").cast("int").alias("end_"))


def merge(*sets: DataFrame) -> DataFrame:
    """Union of intervals; overlapping and abutting ones become one."""
    every = reduce(DataFrame.unionByName, (s.select("chrom", "beg", "end_") for s in sets))
    one = every.withColumn("n", F.lit(1))
    return stitch(sweep(cut(one, ["n"]), ["n"]).filter("n > 0"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("chrom", "beg", "end_", F.lit(1).alias("a"), F.lit(0).alias("b"))
    right = b.select("chrom", "beg", "end_", F.lit(0).alias("a"), F.lit(1).alias("b"))
    return sweep(cut(left.unionByName(right), ["a", "b"]), ["a", "b"])


def intersect(a: DataFrame, *others: DataFrame) -> DataFrame:
    """Stretches that all sets cover."""
    return reduce(lambda x, y: stitch(_both(x, y).filter("a > 0 and b > 0")), others, a if others else merge(a))


def subtract(a: DataFrame, *others: DataFrame) -> DataFrame:
    """Stretches of ``a`` that no other set covers; chromosomes that only ``a`` has stay whole."""
    if not others:
        return merge(a)
    every = reduce(DataFrame.unionByName, (o.select("chrom", "beg", "end_") for o in others))
    return stitch(_both(a, every).filter("a > 0 and b = 0"))


def flank(a: DataFrame, left: int, right: int | None = None, contigs: DataFrame | None = None) -> DataFrame:
    """Extend intervals on both sides, clamped to [0, contig length), not merged."""
    wide = a.select("chrom", F.greatest(F.col("beg") - left, F.lit(0)).alias("beg"), (F.col("end_") + (left if right is None else right)).alias("end_"))
    return clamp(wide, contigs) if contigs is not None else wide


def trim(a: DataFrame, left: int, right: int) -> DataFrame:
    """Merge, shrink each interval, merge; one that is too short stays as it is."""
    merged = merge(a)
    enough = F.col("end_") - F.col("beg") > left + right
    return merge(merged.select("chrom", F.when(enough, F.col("beg") + left).otherwise(F.col("beg")).alias("beg"), F.when(enough, F.col("end_") - right).otherwise(F.col("end_")).alias("end_")))


def to_one_based(a: DataFrame) -> DataFrame:
    return a.select("chrom", (F.col("beg") + 1).alias("beg"), "end_")


def to_zero_based(a: DataFrame) -> DataFrame:
    return a.select("chrom", F.greatest(F.col("beg") - 1, F.lit(0)).alias("beg"), "end_")


def concat(*sets: DataFrame) -> DataFrame:
    """All intervals of all sets, not merged."""
    return reduce(DataFrame.unionByName, (s.select("chrom", "beg", "end_") for s in sets))


def stats(a: DataFrame) -> DataFrame:
    """One row: regions, bases, regions after merging, bases after merging, regions merged away."""
    size = (F.col("end_") - F.col("beg")).cast("bigint")
    total = lambda df, name: df.agg(F.count("*").alias(f"{name}regions"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias(f"{name}bases"))
    both = total(a, "raw_").crossJoin(F.broadcast(total(merge(a), "")))  # one row each
    return both.withColumn("merged_away", F.col("raw_regions") - F.col("regions"))


def clamp(a: DataFrame, contigs: DataFrame) -> DataFrame:
    """Cut intervals at their contig's length; those on unknown contigs stay as they are."""
    joined = a.join(contigs.select("chrom", "length"), "chrom", "left")
    top = F.coalesce(F.least("end_", "length"), F.col("end_")).cast("int")
    return joined.select("chrom", F.least("beg", top).cast("int").alias("beg"), top.alias("end_"))


def bound_violations(a: DataFrame, contigs: DataFrame) -> DataFrame:
    """Intervals that reach past their contig (``out_of_range``) or lie on none that is known (``unknown_contig``)."""
    joined = a.join(contigs.select("chrom", "length"), "chrom", "left")
    kind = F.when(F.col("length").isNull(), "unknown_contig").when((F.col("beg") >= F.col("length")) | (F.col("end_") > F.col("length")), "out_of_range")
    return joined.select("chrom", "beg", "end_", kind.alias("problem")).filter("problem is not null")


def require_in_bounds(a: DataFrame, contigs: DataFrame, mode: str = "error") -> DataFrame:
    """``a`` with violations raised when the plan runs (``error``) or cut away (``clamp``)."""
    if mode == "clamp":
        return clamp(a, contigs)
    joined = a.join(contigs.select("chrom", "length"), "chrom", "left")
    bad = (F.col("beg") >= F.col("length")) | (F.col("end_") > F.col("length"))
    checked: Column = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit("interval out of range on "), F.col("chrom"))).cast("int")).otherwise(F.col("end_"))
    return joined.select("chrom", "beg", checked.alias("end_"))
