"""The coverage report: a long table derived from a few small aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import coverage, depth, intervals, reads as reads_ops


@dataclass(frozen=True)
class Options:
    """What a report depends on. ``flank_minus_target`` leaves the targets out of the flanks; ``max_depth`` cuts the distribution."""

    flank: int = 200
    min_mapq: int = 20
    isize_limit: int = 2000
    uncover: int = 5
    cutoffs: tuple[int, ...] = ()
    ratios: tuple[float, ...] = ()
    max_depth: int | None = None
    flank_minus_target: bool = False

    def __post_init__(self):
        if len(self.cutoffs) > 10 or len(self.ratios) > 10 or any(not 0 < r <= 1 for r in self.ratios) or self.uncover <= 0:
            raise ValueError("at most 10 cutoffs and 10 ratios in (0, 1]; uncover above 0")

    @classmethod
    def parse(cls, cutoffs: str = "", ratios: str = "", **more) -> Options:
        """Options from comma-separated lists."""
        return cls(cutoffs=tuple(int(x) for x in cutoffs.split(",") if x), ratios=tuple(float(x) for x in ratios.split(",") if x), **more)


def flank_set(targets: DataFrame, contigs: DataFrame, options: Options) -> DataFrame:
    wide = intervals.merge(intervals.flank(targets, options.flank, contigs=contigs))
    return intervals.subtract(wide, targets) if options.flank_minus_target else wide


@dataclass(frozen=True)
class Line:
    """A line of the report: its title, its place in JSON (names divided by /), its value in terms of ``raw_numbers`` (SQL), and its form (d, f or p)."""

    title: str
    path: str
    value: str
    form: str


def report_lines(o: Options) -> list[Line]:
    """All lines of the report in their order; titles and places are fixed values of the report's format."""
    share = lambda a, b: f"{a} / nullif({b}, 0) * 100"
    mb = lambda c: f"{c} / 1e6"
    mean = lambda a, b: f"{a} / nullif({b}, 0)"
    cuts = tuple(dict.fromkeys((*coverage.THRESHOLDS, *o.cutoffs)))
    named = lambda t: "gt_0x" if t == 0 else f"ge_{t}x"

    def reached(title: str, path: str, prefix: str) -> list[Line]:
        return [Line(f"{title} ({'>' if t == 0 else '>='}{t}x)", f"{path}/{named(t)}", f"{prefix}x{t}", "p") for t in cuts]

    def covered(t: int) -> Line:
        words = "> 0x" if t == 0 else f">= {t}x" if t in coverage.THRESHOLDS else f"(>={t}x)"
        return Line(f"[Target] Fraction Region covered {words}", f"target/regions_fraction/{named(t)}", share(f"regions_x{t}", "regions"), "p")

    return [
        Line("[Total] Raw Reads (All reads)", "reads/total", "n_reads", "d"),
        Line("[Total] QC Fail reads", "reads/qc_fail", "n_qcfail", "d"),
        Line("[Total] Raw Data(Mb)", "reads/raw_data_mb", mb("n_data"), "f"),
        Line("[Total] Paired Reads", "reads/paired", "n_pair_all", "d"),
        Line("[Total] Mapped Reads", "reads/mapped", "n_mapped", "d"),
        Line("[Total] Fraction of Mapped Reads", "reads/mapped_pct", share("n_mapped", "n_reads"), "p"),
        Line("[Total] Mapped Data(Mb)", "reads/mapped_data_mb", mb("n_mdata"), "f"),
        Line("[Total] Fraction of Mapped Data(Mb)", "reads/mapped_data_pct", share("n_mdata", "n_data"), "p"),
        Line("[Total] Properly paired", "reads/properly_paired", "n_pair_good", "d"),
        Line("[Total] Fraction of Properly paired", "reads/properly_paired_pct", share("n_pair_good", "n_reads"), "p"),
        Line("[Total] Read and mate paired", "reads/read_mate_paired", "n_pair_map", "d"),
        Line("[Total] Fraction of Read and mate paired", "reads/read_mate_paired_pct", share("n_pair_map", "n_reads"), "p"),
        Line("[Total] Singletons", "reads/singletons", "n_sgltn", "d"),
        Line("[Total] Read and mate map to diff chr", "reads/diff_chr", "n_diffchr", "d"),
        Line("[Total] Read1", "reads/read1", "n_read1", "d"),
        Line("[Total] Read2", "reads/read2", "n_read2", "d"),
        Line("[Total] Read1(rmdup)", "reads/read1_rmdup", "n_rmdup1", "d"),
        Line("[Total] Read2(rmdup)", "reads/read2_rmdup", "n_rmdup2", "d"),
        Line("[Total] forward strand reads", "reads/forward_strand", "n_pstrand", "d"),
        Line("[Total] backward strand reads", "reads/backward_strand", "n_mstrand", "d"),
        Line("[Total] PCR duplicate reads", "reads/pcr_duplicate", "n_dup", "d"),
        Line("[Total] Fraction of PCR duplicate reads", "reads/pcr_duplicate_pct", share("n_dup", "n_mapped"), "p"),
        Line("[Total] Map quality cutoff value", "reads/mapq_cutoff", str(o.min_mapq), "d"),
        Line("[Total] MapQuality above cutoff reads", "reads/mapq_above_cutoff", "n_qual", "d"),
        Line("[Total] Fraction of MapQ reads in all reads", "reads/mapq_above_cutoff_in_all_pct", share("n_qual", "n_reads"), "p"),
        Line("[Total] Fraction of MapQ reads in mapped reads", "reads/mapq_above_cutoff_in_mapped_pct", share("n_qual", "n_mapped"), "p"),
        Line("[Insert size] Average", "insert_size/average", "isize_mean", "f"),
        Line("[Insert size] Median", "insert_size/median", "isize_median", "d"),
        Line("[Target] Target Reads", "target/reads", "target_reads", "d"),
        Line("[Target] Fraction of Target Reads in all reads", "target/reads_in_all_pct", share("target_reads", "n_reads"), "p"),
        Line("[Target] Fraction of Target Reads in mapped reads", "target/reads_in_mapped_pct", share("target_reads", "n_mapped"), "p"),
        Line("[Target] Target Data(Mb)", "target/data_mb", mb("target_data"), "f"),
        Line("[Target] Target Data Rmdup(Mb)", "target/data_rmdup_mb", mb("rmdup_data"), "f"),
        Line("[Target] Fraction of Target Data in all data", "target/data_in_all_pct", share("target_data", "n_data"), "p"),
        Line("[Target] Fraction of Target Data in mapped data", "target/data_in_mapped_pct", share("target_data", "n_mdata"), "p"),
        Line("[Target] Len of region", "target/region_len", "target_length", "d"),
        Line("[Target] Average depth", "target/avg_depth", mean("target_data", "target_length"), "f"),
        Line("[Target] Average depth(rmdup)", "target/avg_depth_rmdup", mean("rmdup_data", "target_length"), "f"),
        Line("[Target] Coverage (>0.2*(Average depth)x)", "target/coverage/gt_02x_avg", "u020", "p"),
        Line("[Target] Coverage (>0.5*(Average depth)x)", "target/coverage/gt_05x_avg", "u050", "p"),
        *reached("[Target] Coverage", "target/coverage", ""),
        *reached("[Target] Coverage(rmdup)", "target/coverage_rmdup", "rmdup_"),
        *(Line(f"[Target] Coverage (>{r:.2f}*Avg)", f"target/coverage_ratio/gt_{r:.2f}_avg", f"ratio{i}", "p") for i, r in enumerate(o.ratios)),
        Line("[Target] Target Region Count", "target/region_count", "regions", "d"),
        Line("[Target] Region covered > 0x", "target/regions_covered_gt_0x", "regions_x0", "d"),
        *(covered(t) for t in cuts),
        Line("[flank] flank size", "flank/size", str(o.flank), "d"),
        Line("[flank] Len of region (not include target region)", "flank/region_len", "flank_length", "d"),
        Line("[flank] Average depth", "flank/avg_depth", mean("flank_data", "flank_length"), "f"),
        Line("[flank] flank Reads", "flank/reads", "flank_reads", "d"),
        Line("[flank] Fraction of flank Reads in all reads", "flank/reads_in_all_pct", share("flank_reads", "n_reads"), "p"),
        Line("[flank] Fraction of flank Reads in mapped reads", "flank/reads_in_mapped_pct", share("flank_reads", "n_mapped"), "p"),
        Line("[flank] flank Data(Mb)", "flank/data_mb", mb("flank_data"), "f"),
        Line("[flank] Fraction of flank Data in all data", "flank/data_in_all_pct", share("flank_data", "n_data"), "p"),
        Line("[flank] Fraction of flank Data in mapped data", "flank/data_in_mapped_pct", share("flank_data", "n_mdata"), "p"),
        *reached("[flank] Coverage", "flank/coverage", "flank_"),
    ]


#: Histograms that a report holds: depth with deletions, depth of clean reads, aligned bases around the targets, and the targets' mean depths, cut to whole numbers.
COV, RMDUP, FLANK, REGION = 0, 1, 2, 3


def depth_histograms(runs: DataFrame) -> DataFrame:
    """(kind, value, cnt) of COV and RMDUP on targets, of FLANK and of REGION, from one reading of ``zone_runs``."""
    place = ("chrom", "beg", "end_")

    def one(on: str, kind: int, m: str | None):
        """The row of a run in a histogram: its depth, or (no measure) its target, which has its depth once all its runs are summed."""
        return F.when(F.col(on), F.struct(F.lit(kind).alias("kind"), (F.col(m) if m else F.lit(None).cast("bigint")).alias("value"), *(F.when(F.lit(m is None), F.col(c)).alias(c) for c in place)))

    kinds = F.array(one("on_target", COV, "cov"), one("on_target", RMDUP, "rmdup"), one("on_flank", FLANK, "raw"), one("on_target", REGION, None))
    size = coverage.run_size().cast("bigint")
    rows = runs.select(F.explode(kinds).alias("k"), size.alias("size"), (F.col("raw") * size).alias("data")).filter("k is not null")
    rows = rows.groupBy("k.kind", "k.value", *(f"k.{c}" for c in place)).agg(F.sum("size").alias("size"), F.sum("data").alias("data"))
    region = F.col("kind") == REGION
    value, cnt = F.when(region, F.floor(F.col("data") / F.col("size"))).otherwise(F.col("value")), F.when(region, 1).otherwise(F.col("size"))
    return rows.select("kind", value.cast("bigint").alias("value"), cnt.alias("cnt")).groupBy("kind", "value").agg(F.sum("cnt").cast("bigint").alias("cnt"))


def raw_numbers(reads: DataFrame, targets: DataFrame, contigs: DataFrame, options: Options) -> DataFrame:
    """One row of all numbers that ``report_lines`` refer to: one sweep, a pass each for flags and insert sizes, and two joins of reads with zones."""
    merged, flanks = intervals.merge(targets), flank_set(targets, contigs, options)
    runs = depth.zone_runs(reads, merged, flanks, options.min_mapq)
    eligible = reads_ops.depth_eligible(reads)
    cuts = tuple(dict.fromkeys((*coverage.THRESHOLDS, *options.cutoffs)))

    flags, sizes = reads_ops.flagstat(reads, options.min_mapq), reads_ops.insert_sizes(reads, options.isize_limit)

    # a row for each depth; the mean and the thresholds that hang on it come from windows over these
    of_kind = Window.partitionBy("kind")
    hist = depth_histograms(runs).withColumn("data", F.sum(F.col("value") * F.col("cnt")).over(of_kind)).withColumn("n", F.sum("cnt").over(of_kind))
    whole, mean = F.floor(F.col("data") / F.col("n")), F.col("data") / F.col("n")
    is_kind = lambda k: F.col("kind") == k
    total = lambda k, v, name: F.coalesce(F.sum(F.when(is_kind(k), v)), F.lit(0)).cast("bigint").alias(name)

    def share(k: int, c, name: str):
        return (F.coalesce(F.sum(F.when(is_kind(k) & c, F.col("cnt"))), F.lit(0)) / F.nullif(F.sum(F.when(is_kind(k), F.col("cnt"))), F.lit(0)) * 100).alias(name)

    at = lambda t: F.col("value") > 0 if t == 0 else F.col("value") >= t
    bases = F.col("value") * F.col("cnt")
    # a ratio's threshold is never below that of a ratio before it
    upto = lambda i: F.greatest(*(F.floor(r * mean) for r in options.ratios[: i + 1])) if i else F.floor(options.ratios[0] * mean)
    depths = hist.agg(
        total(COV, bases, "target_data"), total(COV, F.col("cnt"), "target_length"), total(RMDUP, bases, "rmdup_data"), total(FLANK, bases, "flank_data"), total(FLANK, F.col("cnt"), "flank_length"),
        *(share(k, at(t), f"{prefix}x{t}") for k, prefix in ((COV, ""), (RMDUP, "rmdup_"), (FLANK, "flank_")) for t in cuts),
        *(share(COV, F.col("value") >= F.floor(whole * r), f"u{int(r * 100):03d}") for r in (0.2, 0.5)),
        *(share(COV, F.col("value") > upto(i), f"ratio{i}") for i in range(len(options.ratios))),
        total(REGION, F.col("cnt"), "regions"), *(total(REGION, F.when(at(t), F.col("cnt")), f"regions_x{t}") for t in cuts),
    )

    parts = [
        depths, coverage.mean_of(sizes).toDF("isize_mean"), coverage.rank_median(sizes).toDF("isize_median"),
        reads_ops.overlapping(eligible, merged).agg(F.count("*").alias("target_reads")), reads_ops.overlapping(eligible, flanks).agg(F.count("*").alias("flank_reads")),
    ]
    for part in parts:
        flags = flags.crossJoin(F.broadcast(part))  # one row each
    return flags


def coverage_report(reads: DataFrame, targets: DataFrame, contigs: DataFrame, options: Options = Options()) -> DataFrame:
    """(ord, key, value) of all lines of the report; every value is a double, null where there is nothing to divide by."""
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(x.title).alias("key"), F.expr(x.value).cast("double").alias("value")) for i, x in enumerate(report_lines(options))))
    return raw_numbers(reads, targets, contigs, options).select(F.explode(rows).alias("r")).select("r.ord", "r.key", "r.value")
