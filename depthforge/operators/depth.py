"""Per-base depth by an event sweep, without a row for each base.

Aligned segments become +1/-1 events in fixed-width bins; targets add events of weight zero, so
that bases without reads have runs too. Events are summed before the shuffle, so its size follows
the distinct boundaries and not the reads, and no task holds more than a bin's share of a contig.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import reference_segments, with_events
from .intervals import BIN_BITS, cut
from .reads import depth_eligible, is_clean

MEASURES = ["raw", "rmdup", "cov"]


def segments(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """(chrom, beg, end_, raw, rmdup, cov) of the aligned and deleted stretches of eligible reads."""
    rows = depth_eligible(reads).select("chrom", is_clean(min_mapq).alias("clean"), F.explode(reference_segments(F.col("pos"), F.col("cigar"))).alias("s"))
    base = ~F.col("s.is_del")
    return rows.select("chrom", F.col("s.beg").alias("beg"), F.col("s.end").alias("end_"), base.cast("int").alias("raw"), (base & F.col("clean")).cast("int").alias("rmdup"), F.lit(1).alias("cov"))


def zone_runs(reads: DataFrame, targets: DataFrame, flanks: DataFrame | None = None, min_mapq: int = 20, bits: int = BIN_BITS) -> DataFrame:
    """Runs (chrom, beg, end_, lo, hi, raw, rmdup, cov, on_target, on_flank) of equal depth in merged targets and merged flanks, in one sweep.

    raw: aligned bases; rmdup: those of clean reads; cov: raw and deleted bases. ``beg`` and ``end_`` are those of
    the target that a run lies in, null beside targets. Together the runs of an interval are the
    interval; a run ends at the edge of a bin at the latest.
    """
    number = lambda v: F.lit(v).cast("bigint")
    ends = lambda *of: F.explode(F.array(*(F.struct(F.col(at).alias("p"), *rest) for at, rest in zip(("lo", "hi"), of, strict=True))))
    none = F.lit(None).cast("int")
    names = [*MEASURES, "on_target", "on_flank", "beg", "end_"]
    still = [number(0).alias(m) for m in MEASURES]
    beside = [number(0).alias("on_target"), number(0).alias("on_flank"), none.alias("beg"), none.alias("end_")]
    zone = cut(targets.select("chrom", "beg", "end_", F.col("beg").cast("int").alias("first"), F.col("end_").cast("int").alias("last")), ["first", "last"], bits)
    enter = [*still, number(1).alias("on_target"), number(0).alias("on_flank"), F.col("first").alias("beg"), F.col("last").alias("end_")]
    leave = [*still, number(-1).alias("on_target"), number(0).alias("on_flank"), none.alias("beg"), none.alias("end_")]
    marks = zone.select("chrom", "bin", ends(enter, leave).alias("e"))
    if flanks is not None:
        edge = lambda n: [*still, number(0).alias("on_target"), number(n).alias("on_flank"), none.alias("beg"), none.alias("end_")]
        marks = marks.unionByName(cut(flanks, [], bits).select("chrom", "bin", ends(edge(1), edge(-1)).alias("e")))
    # a column of its own and the outer form: events are computed once a read, in compiled code
    reads = with_events(depth_eligible(reads).select("chrom", "pos", "cigar", is_clean(min_mapq).alias("clean")), bits).select("chrom", "clean", F.explode_outer("events").alias("e"))
    # events of one place are summed before the shuffle, so a bin has no more rows than bases (and marks), however deep it is
    events = reads.filter("e.p is not null").groupBy("chrom", F.col("e.p").alias("p")).agg(F.sum("e.raw").alias("raw"), F.sum(F.when(F.col("clean"), F.col("e.raw")).otherwise(0)).alias("rmdup"), F.sum("e.cov").alias("cov"))
    places = events.select("chrom", F.shiftright("p", bits).alias("bin"), "p", *MEASURES, *beside).unionByName(marks.select("chrom", "bin", "e.p", *(f"e.{c}" for c in names)))
    wanted = marks.select("chrom", "bin").distinct()
    # rows of one place are peers: each has the sums of all of them, and all but one have no length
    order = Window.partitionBy("chrom", "bin").orderBy("p")
    sums = [F.sum(c).over(order).alias(c) for c in names[:5]]
    runs = places.join(wanted, ["chrom", "bin"], "left_semi").select("chrom", F.col("p").alias("lo"), F.lead("p").over(order).alias("hi"), *(F.last(c, ignorenulls=True).over(order).alias(c) for c in ("beg", "end_")), *sums)
    inside = F.col("on_target") > 0
    edges = [F.when(inside, F.col(c)).alias(c) for c in ("beg", "end_")]
    return runs.filter((F.col("hi") > F.col("lo")) & (inside | (F.col("on_flank") > 0))).select("chrom", *edges, "lo", "hi", *MEASURES, inside.alias("on_target"), (F.col("on_flank") > 0).alias("on_flank"))


def depth_runs(reads: DataFrame, targets: DataFrame, min_mapq: int = 20, bits: int = BIN_BITS) -> DataFrame:
    """Runs (chrom, beg, end_, lo, hi, raw, rmdup, cov) of equal depth in each merged target, as in ``zone_runs``."""
    return zone_runs(reads, targets, None, min_mapq, bits).drop("on_target", "on_flank")


def per_base(runs: DataFrame) -> DataFrame:
    """(chrom, pos from 1, raw, rmdup, cov): a row for each base of the targets."""
    return runs.select("chrom", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("pos"), *MEASURES)
