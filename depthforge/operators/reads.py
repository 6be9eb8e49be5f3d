"""Read-level statistics and joins.

``reads``: chrom, pos, flag, mapq, l_qseq, mchrom, isize, cigar (chrom null: not placed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cigar import reference_end
from ..functions.flags import DUP, MUNMAP, PAIRED, PROPER, QCFAIL, READ1, READ2, REVERSE, SECONDARY, SUPP, UNMAP, has, primary, read_class
from .intervals import BIN_BITS


def depth_eligible(reads: DataFrame) -> DataFrame:
    """Primary, placed reads that are not of class unmapped; reads that failed QC stay in, mapped or not."""
    return reads.filter(eligible())


def eligible() -> Column:
    # one look at the flag: where it is an expression of other columns, each look repeats that in compiled code, and Java leaves methods of more than 8000 bytes uncompiled
    return F.col("flag").bitwiseAND(F.lit(SECONDARY | SUPP | QCFAIL | UNMAP)).isin(0, QCFAIL, QCFAIL | UNMAP) & F.col("chrom").isNotNull()


def is_clean(min_mapq: int = 20) -> Column:
    """Not a duplicate (class 2), and mapped well enough."""
    return ~F.col("flag").bitwiseAND(F.lit(QCFAIL | UNMAP | DUP)).eqNullSafe(F.lit(DUP)) & (F.col("mapq") >= min_mapq)


def counters() -> dict[str, tuple[Column, Column | None]]:
    """Condition of each flag counter over ``_classes``, and what it sums (none: it counts reads)."""
    ok = ~has(QCFAIL)
    pair = ok & has(PAIRED)
    mapped = ok & ~has(UNMAP)
    both = pair & ~has(UNMAP) & ~has(MUNMAP)
    placed = F.col("placed") & read_class().isin(0, 1)
    bases, every = F.col("bases"), F.lit(True)
    return {
        "n_reads": (every, None), "n_data": (every, bases), "n_qcfail": (has(QCFAIL), None), "n_pair_all": (pair, None), "n_pair_good": (pair & has(PROPER) & ~has(UNMAP), None),
        "n_read1": (pair & has(READ1), None), "n_read2": (pair & has(READ2), None), "n_sgltn": (pair & has(MUNMAP) & ~has(UNMAP), None), "n_pair_map": (both, None),
        "n_diffchr": (both & ~F.col("home"), None), "n_mapped": (mapped, None), "n_mdata": (mapped, bases), "n_mstrand": (mapped & has(REVERSE), None),
        "n_pstrand": (mapped & ~has(REVERSE), None), "n_dup": (mapped & has(DUP), None), "n_qual": (F.col("good"), None), "n_rmdup1": (placed & has(READ1), None), "n_rmdup2": (placed & has(READ2), None),
    }


def _classes(reads: DataFrame, min_mapq: int, *by: Column) -> DataFrame:
    """Primary reads by all that the counters look at: flag, good (mapped well enough), placed, home (mate on the same contig), with n and bases.

    The counters' conditions are too much code to run on each read; there are few classes.
    """
    keys = ((F.col("mapq") >= min_mapq).alias("good"), F.col("chrom").isNotNull().alias("placed"), F.col("mchrom").eqNullSafe(F.col("chrom")).alias("home"))
    return reads.filter(primary()).groupBy(*by, "flag", *keys).agg(F.count("*").alias("n"), F.sum(F.col("l_qseq").cast("bigint")).alias("bases"))


def _counted() -> list[Column]:
    return [F.coalesce(F.sum(F.when(c, F.col("n") if v is None else v)), F.lit(0)).cast("bigint").alias(name) for name, (c, v) in counters().items()]


def flagstat(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """All flag counters in one pass and one row."""
    return _classes(reads, min_mapq).agg(*_counted())


def counters_by_size(reads: DataFrame, min_mapq: int = 20, limit: int = 2000) -> DataFrame:
    """Flag counters and the insert sizes in one pass: (size, cnt, counters), a row for each insert size; reads without one are under 0."""
    size = F.when(eligible() & (F.col("isize") > 0) & (F.col("isize") < limit), F.col("isize")).otherwise(0)
    return _classes(reads, min_mapq, size.alias("size")).groupBy("size").agg(F.sum("n").alias("cnt"), *_counted())


#: Fractions of the report: name, counter above, counter below.
FRACTIONS = (("mapped", "n_mapped", "n_reads"), ("mapped_data", "n_mdata", "n_data"), ("proper_pairs", "n_pair_good", "n_reads"), ("paired", "n_pair_map", "n_reads"), ("singletons", "n_sgltn", "n_reads"), ("duplicates", "n_dup", "n_mapped"), ("other_contig", "n_diffchr", "n_pair_map"), ("well_mapped", "n_qual", "n_reads"), ("reverse", "n_mstrand", "n_mapped"))


def flag_fractions(counters: DataFrame) -> DataFrame:
    """(metric, pct): percentages of the counters; a zero below gives null."""
    parts = [F.struct(F.lit(name).alias("metric"), (F.col(a) / F.nullif(F.col(b), F.lit(0)) * 100).alias("pct")) for name, a, b in FRACTIONS]
    return counters.select(F.explode(F.array(*parts)).alias("x")).select("x.metric", "x.pct")


def insert_sizes(reads: DataFrame, limit: int = 2000) -> DataFrame:
    """Histogram (value, cnt) of 0 < isize < limit over mapped primary reads."""
    return depth_eligible(reads).filter((F.col("isize") > 0) & (F.col("isize") < limit)).groupBy(F.col("isize").alias("value")).agg(F.count("*").alias("cnt"))


def with_span(reads: DataFrame) -> DataFrame:
    """Reads with ``span_end``, at least one base past the start."""
    return reads.withColumn("span_end", F.greatest(reference_end(F.col("pos"), F.col("cigar")), F.col("pos") + 1))


def overlapping(reads: DataFrame, targets: DataFrame, how: str = "left_semi", bits: int = BIN_BITS) -> DataFrame:
    """Reads whose reference span overlaps a target (``left_semi``) or none (``left_anti``).

    A read of a usual span, no longer than a bin, stays one row with the bin of its start; targets
    lie in their own bins and in the one before, so the join is an equality on (chrom, bin) and a range.
    The few longer reads have a row for each bin they touch, and are put together again. How targets
    are laid out does not depend on the reads, so one long gap in a read costs that read alone.
    """
    if how not in ("left_semi", "left_anti"):
        raise ValueError("how is left_semi or left_anti")
    spans, wide = with_span(reads), 1 << bits
    long = F.col("span_end") - F.col("pos") > wide
    lay = lambda ahead: targets.filter("end_ > beg").select("chrom", "beg", "end_", F.explode(F.sequence(F.shiftright(F.greatest(F.col("beg") - ahead, F.lit(0)), bits), F.shiftright(F.col("end_") - 1, bits))).alias("bin"))
    near = lambda a, b: (a["chrom"] == b["chrom"]) & (a["bin"] == b["bin"]) & (a["pos"] < b["end_"]) & (b["beg"] < a["span_end"])
    usual, zones = spans.filter(~long).withColumn("bin", F.shiftright("pos", bits)), lay(wide)
    found = usual.join(zones, near(usual, zones), how).select(*reads.columns)
    far = spans.filter(long).select(F.struct(*reads.columns).alias("read"), F.monotonically_increasing_id().alias("id"), "chrom", "pos", "span_end")
    far, zones = far.withColumn("bin", F.explode(F.sequence(F.shiftright("pos", bits), F.shiftright(F.col("span_end") - 1, bits)))), lay(0)
    each = far.join(zones, near(far, zones), "left").groupBy(far["id"]).agg(F.any_value(far["read"]).alias("read"), F.max(zones["beg"].isNotNull()).alias("hit"))
    return found.unionByName(each.filter(F.col("hit") == (how == "left_semi")).select("read.*"))


def fetch_region(reads: DataFrame, chrom: str, beg: int, end: int) -> DataFrame:
    """Placed reads that overlap [beg, end) of a contig."""
    spans = with_span(reads.filter((F.col("chrom") == chrom) & (F.col("pos") < end)))
    return spans.filter(F.col("span_end") > beg).drop("span_end")


def idxstats(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """(chrom, length, mapped, unmapped) of each contig, all records; unplaced ones under ``*``."""
    counts = reads.groupBy(F.coalesce("chrom", F.lit("*")).alias("chrom")).agg(F.count_if(~has(UNMAP)).alias("mapped"), F.count_if(has(UNMAP)).alias("unmapped"))
    every = contigs.select("chrom", F.col("length").cast("bigint").alias("length")).unionByName(contigs.sparkSession.range(1).select(F.lit("*").alias("chrom"), F.lit(0).cast("bigint").alias("length")))
    return every.join(counts, "chrom", "left").select("chrom", "length", F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"))


def bin_index(reads: DataFrame) -> DataFrame:
    """(chrom, bin, n, min_pos, max_end) of placed reads in each hierarchical bin."""
    from ..functions.bins import region_bin

    spans = with_span(reads.filter("chrom is not null"))
    return spans.groupBy("chrom", region_bin(F.col("pos"), F.col("span_end")).alias("bin")).agg(F.count("*").alias("n"), F.min("pos").alias("min_pos"), F.max("span_end").alias("max_end"))


def linear_index(reads: DataFrame, bits: int = BIN_BITS) -> DataFrame:
    """(chrom, window, first_pos): least start of a read that overlaps each 16 kb window, gaps filled from before."""
    spans = with_span(reads.filter("chrom is not null"))
    seen = spans.select("chrom", "pos", F.explode(F.sequence(F.shiftright("pos", bits), F.shiftright(F.col("span_end") - 1, bits))).alias("window")).groupBy("chrom", "window").agg(F.min("pos").alias("first_pos"))
    every = seen.groupBy("chrom").agg(F.max("window").alias("w")).select("chrom", F.explode(F.sequence(F.lit(0), F.col("w"))).alias("window"))
    # one row for each 16 kb of a contig, so the window over a contig is small
    before = Window.partitionBy("chrom").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(seen, ["chrom", "window"], "left").select("chrom", "window", F.coalesce(F.last("first_pos", ignorenulls=True).over(before), F.lit(0)).alias("first_pos"))


def unsorted_reads(reads: DataFrame, file: str = "file_idx", record: str = "rec_idx", block: int = 1 << 20) -> DataFrame:
    """Records that start before the record before them on the same contig of a file.

    Records are compared inside blocks of record numbers, and each block's first with the last of the block before.
    """
    seen = _with_previous(reads, file, record, block)
    return seen.filter((F.col("chrom") == F.col("before.chrom")) & (F.col("pos") < F.col("before.pos"))).select(*reads.columns)


def split_contigs(reads: DataFrame, file: str = "file_idx", record: str = "rec_idx", block: int = 1 << 20) -> DataFrame:
    """(file, chrom, stretches) of contigs whose records lie in more than one stretch of a file, so that the file is not sorted. Unplaced records are left out."""
    seen = _with_previous(reads, file, record, block).filter(F.col("chrom").isNotNull() & ~F.col("chrom").eqNullSafe(F.col("before.chrom")))
    return seen.groupBy(file, "chrom").agg(F.count("*").alias("stretches")).filter("stretches > 1")


def _with_previous(reads: DataFrame, file: str, record: str, block: int) -> DataFrame:
    """``reads`` with ``before``, chrom and pos of the record before."""
    part = reads.withColumn("block", F.floor(F.col(record) / block))
    inner = Window.partitionBy(file, "block").orderBy(record)
    seen = part.withColumn("inside", F.lag(F.struct("chrom", "pos")).over(inner)).withColumn("first", F.row_number().over(inner) == 1)
    lasts = part.groupBy(file, "block").agg(F.max_by(F.struct("chrom", "pos"), record).alias("tail")).withColumn("block", F.col("block") + 1)
    return seen.join(lasts, [file, "block"], "left").withColumn("before", F.when(F.col("first"), F.col("tail")).otherwise(F.col("inside")))


def valid_record(contigs_count: int) -> Column:
    """Whether contig numbers and lengths of a record make sense (tid, mtid within the dictionary)."""
    return (F.col("tid") >= -1) & (F.col("tid") < contigs_count) & (F.col("mtid") >= -1) & (F.col("mtid") < contigs_count) & (F.col("l_qseq") >= 0)


def with_library(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """Add ``library`` by read group: ``groups`` has rg and library."""
    return reads.join(groups.select(F.col("rg").alias("_rg"), "library"), F.col("rg") == F.col("_rg"), "left").drop("_rg")
