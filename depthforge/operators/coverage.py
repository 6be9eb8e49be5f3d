"""Histograms, thresholds and summaries over runs of depth.

A histogram is (value, cnt). All of these weigh runs by their length, so nothing is expanded to bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (0, 4, 10, 30, 100)


def run_size() -> Column:
    return F.col("hi") - F.col("lo")


def histogram(runs: DataFrame, measure: str = "cov", by: tuple[str, ...] = ()) -> DataFrame:
    return runs.groupBy(*by, F.col(measure).alias("value")).agg(F.sum(run_size()).cast("bigint").alias("cnt"))


def fold(*histograms: DataFrame) -> DataFrame:
    """Sum of histograms."""
    every = histograms[0]
    for h in histograms[1:]:
        every = every.unionByName(h)
    return every.groupBy("value").agg(F.sum("cnt").cast("bigint").alias("cnt"))


def dense(hist: DataFrame) -> DataFrame:
    """All values from 0 to the largest, absent ones with count 0."""
    every = hist.agg(F.max("value").alias("m")).filter("m is not null").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m").cast("bigint"))).alias("value"))
    return every.join(hist, "value", "left").select("value", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def cap(hist: DataFrame, max_depth: int | None) -> DataFrame:
    """Values up to ``max_depth`` (none: all)."""
    return hist if max_depth is None else hist.filter(F.col("value") <= max_depth)


def cumulative(hist: DataFrame) -> DataFrame:
    """(value, cnt, frac, cumu_cnt, cumu_frac): share of a value, and count and share above it."""
    # a histogram has a row for each depth, whatever the reads
    upto = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("cnt").over(whole)
    above = (total - F.sum("cnt").over(upto)).cast("bigint")
    return hist.select("value", "cnt", (F.col("cnt") / F.nullif(total, F.lit(0))).alias("frac"), above.alias("cumu_cnt"), (above / F.nullif(total, F.lit(0))).alias("cumu_frac"))


def _share(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, F.col("cnt"))), F.lit(0)) / F.nullif(F.sum("cnt"), F.lit(0)) * 100


def thresholds(hist: DataFrame, cutoffs: tuple[int, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """Percentages of positions above 0 and at least 4, 10, 30, 100 and each cutoff; columns x0, x4, ... ."""
    each = [_share(F.col("value") > 0 if t == 0 else F.col("value") >= t).alias(f"x{t}") for t in dict.fromkeys((*THRESHOLDS, *cutoffs))]
    return hist.groupBy(*by).agg(*each) if by else hist.agg(*each)


def _mean(hist: DataFrame, length: int | Column | None) -> DataFrame:
    """``mean`` in one row, over ``length`` (None: all that the histogram counts); null without a length."""
    data = hist.agg(F.coalesce(F.sum(F.col("value") * F.col("cnt")), F.lit(0)).alias("data"), F.sum("cnt").alias("n"))
    n = F.col("n") if length is None else F.lit(length)
    return data.select((F.col("data") / F.nullif(n, F.lit(0))).alias("mean"))


def uniformity(hist: DataFrame, length: int | Column | None = None) -> DataFrame:
    """Percentages at or above 0.2 and 0.5 of the whole-number mean; thresholds are cut to whole numbers. No length: null."""
    data = _mean(hist, length).select(F.floor("mean").alias("mean"))
    joined = hist.crossJoin(F.broadcast(data))  # one row
    return joined.agg(*(_share(F.col("value") >= F.floor(F.col("mean") * r)).alias(f"u{int(r * 100):03d}") for r in (0.2, 0.5)))


def ratio_coverage(hist: DataFrame, length: int | None, ratios: tuple[float, ...]) -> DataFrame:
    """(ord, ratio, threshold, pct): positions above floor(ratio * mean); thresholds never fall along the list. ``length`` as in ``_mean``."""
    if len(ratios) > 10 or any(not 0 < r <= 1 for r in ratios):
        raise ValueError("at most 10 ratios, each above 0 and not above 1")
    each = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(float(r)).alias("ratio")) for i, r in enumerate(ratios))).cast("array<struct<ord:int,ratio:double>>")
    own = _mean(hist, length).select("mean", F.inline(each)).select("ord", "ratio", F.max(F.floor(F.col("ratio") * F.col("mean"))).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)).alias("threshold"))
    return hist.crossJoin(F.broadcast(own)).groupBy("ord", "ratio", "threshold").agg(_share(F.col("value") > F.col("threshold")).alias("pct"))


def rank_median(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``median``: least value whose cumulated count is floor(n/2) or more; 0 for n of 0 or 1."""
    upto = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    marked = hist.withColumn("upto", F.sum("cnt").over(upto)).withColumn("n", F.sum("cnt").over(whole))
    hit = F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2), F.col("value")))
    value = F.when(F.max("n") > 1, hit).otherwise(0)
    out = marked.groupBy(*by).agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("median"))
    return out


def mean_of(hist: DataFrame) -> DataFrame:
    return hist.agg((F.sum(F.col("value") * F.col("cnt")) / F.nullif(F.sum("cnt"), F.lit(0))).alias("mean"))


def region_stats(runs: DataFrame) -> DataFrame:
    """(chrom, beg, end_, avg, median, cov_pct, covfix_pct) of each target: mean and median of raw depth, share of raw and of cov above 0."""
    n = F.sum(run_size())
    share = lambda m: F.coalesce(F.sum(F.when(F.col(m) > 0, run_size())), F.lit(0)) / n * 100
    return runs.groupBy("chrom", "beg", "end_").agg((F.sum(F.col("raw") * run_size()) / n).alias("avg"), F.percentile("raw", 0.5, run_size().cast("int")).alias("median"), share("raw").alias("cov_pct"), share("cov").alias("covfix_pct"))


def region_mean_histogram(regions: DataFrame) -> DataFrame:
    """Histogram of the regions' mean depths, cut to whole numbers."""
    return regions.groupBy(F.floor("avg").cast("bigint").alias("value")).agg(F.count("*").alias("cnt"))


def chrom_report(runs: DataFrame, cutoffs: tuple[int, ...] = ()) -> DataFrame:
    """(chrom, data_pct, mean, median, x0, ..., x100, cutoffs) of cov depth for each contig with targets; contigs without reads have zeros.

    The sweep is read once: its histogram has a row for each contig and depth.
    """
    by = Window.partitionBy("chrom")
    hist = histogram(runs, "cov", ("chrom",)).withColumn("upto", F.sum("cnt").over(by.orderBy("value"))).withColumn("n", F.sum("cnt").over(by))
    data = F.sum(F.col("value") * F.col("cnt"))
    median = F.when(F.max("n") > 1, F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2), F.col("value")))).otherwise(0)
    shares = [_share(F.col("value") > 0 if t == 0 else F.col("value") >= t).alias(f"x{t}") for t in dict.fromkeys((*THRESHOLDS, *cutoffs))]
    each = hist.groupBy("chrom").agg(data.cast("bigint").alias("data"), (data / F.sum("cnt")).alias("mean"), F.coalesce(median, F.lit(0)).cast("bigint").alias("median"), *shares)
    total = F.sum("data").over(Window.partitionBy())  # a row for each contig
    return each.withColumn("data_pct", F.coalesce(F.col("data") / F.nullif(total, F.lit(0)) * 100, F.lit(0.0))).select("chrom", "data_pct", "mean", "median", *each.columns[4:])


def uncovered(runs: DataFrame, cutoff: int = 5) -> DataFrame:
    """(chrom, beg, end_): longest stretches of each target with cov depth below ``cutoff``."""
    low = runs.filter(F.col("cov") < cutoff)
    order = Window.partitionBy("chrom", "beg").orderBy("lo")
    new = F.when(F.col("lo") > F.coalesce(F.lag("hi").over(order), F.lit(-1)), 1).otherwise(0)
    marked = low.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    return marked.groupBy("chrom", "beg", "island").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).select("chrom", F.col("first").cast("int").alias("beg"), F.col("last").cast("int").alias("end_"))


def missing_contigs(reads: DataFrame, targets: DataFrame) -> DataFrame:
    """Contigs with targets on which no read lies."""
    return targets.select("chrom").distinct().join(reads.select("chrom").filter("chrom is not null").distinct(), "chrom", "left_anti")
