"""The registered queries over the driver's tables, and their SQL for DuckDB.

The SQL takes other ways than the queries: depth is counted base by base, intervals are merged with a
window over a whole contig, and overlaps are joined by ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins, cigar, flags, tags
from ..operators import coverage, depth, intervals, order, reads as reads_ops
from ..sources import sinks, text
from ..sources.fixtures import CONTIG_LENGTH, OTHER_COLUMNS, READS_COLUMNS, TARGET_COLUMNS, load_contigs, load_reads, load_targets
from .report import Options, coverage_report, flank_set, report_lines

FLANK, UNCOVER, LIMIT = 200, 5, 2000
RATIOS, CUTOFFS = (0.2, 0.5, 0.4, 1.0), (20, 50)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL parts ---------------------------------------------------------------------------------

R = f"r AS (SELECT {', '.join(READS_COLUMNS)} FROM lineitem), p AS (SELECT *, pos+m1+d+n+m2 AS span_end FROM r WHERE (flag & 2304) = 0), e AS (SELECT * FROM p WHERE (flag & 512) <> 0 OR (flag & 4) = 0)"
T = f"t AS (SELECT {', '.join(TARGET_COLUMNS)} FROM part)"
O = f"o AS (SELECT {', '.join(OTHER_COLUMNS)} FROM part)"


def merged(source: str, name: str) -> str:
    return f"""{name}1 AS (SELECT *, max(end_) OVER (PARTITION BY chrom ORDER BY beg, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}),
{name}2 AS (SELECT *, sum(CASE WHEN before >= beg THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY beg, end_ ROWS UNBOUNDED PRECEDING) AS island FROM {name}1),
{name} AS (SELECT chrom, CAST(min(beg) AS INT) AS beg, CAST(max(end_) AS INT) AS end_ FROM {name}2 GROUP BY chrom, island)"""


M = f"{T}, {merged('t', 'm')}"
FL = f"{M}, fl AS (SELECT chrom, greatest(beg-{FLANK}, 0) AS beg, least(end_+{FLANK}, {CONTIG_LENGTH}) AS end_ FROM t), {merged('fl', 'f')}"
SEG = """s AS (SELECT chrom, pos AS b, pos+m1 AS e, 1 AS raw, CASE WHEN c THEN 1 ELSE 0 END AS rmdup FROM ec UNION ALL
 SELECT chrom, pos+m1, pos+m1+d, 0, 0 FROM ec WHERE d > 0 UNION ALL
 SELECT chrom, pos+m1+d+n, pos+m1+d+n+m2, 1, CASE WHEN c THEN 1 ELSE 0 END FROM ec)"""


def bases(zone: str, name: str = "dep") -> str:
    return f"""ec AS (SELECT *, ((flag & 512) <> 0 OR (flag & 1024) = 0) AND mapq >= 20 AS c FROM e), {SEG},
x AS (SELECT chrom, unnest(range(b, e)) AS q, raw, rmdup FROM s), y AS (SELECT chrom, q, sum(raw) AS raw, sum(rmdup) AS rmdup, count(*) AS cov FROM x GROUP BY chrom, q),
z AS (SELECT chrom, beg, end_, unnest(range(beg, end_)) AS q FROM {zone}),
{name} AS (SELECT z.chrom, beg, end_, z.q, CAST(coalesce(raw, 0) AS BIGINT) AS raw, CAST(coalesce(rmdup, 0) AS BIGINT) AS rmdup, CAST(coalesce(cov, 0) AS BIGINT) AS cov FROM z LEFT JOIN y ON z.chrom = y.chrom AND z.q = y.q)"""


DEP = f"WITH {R}, {M}, {bases('m')}"
FDEP = f"WITH {R}, {FL}, {bases('f')}"
HIST = "h AS (SELECT {m} AS value, count(*) AS cnt FROM dep GROUP BY 1)"
IS = f"WITH {R}, h AS (SELECT isize AS value, count(*) AS cnt FROM e WHERE isize > 0 AND isize < {LIMIT} GROUP BY 1)"
CUMULATIVE = "SELECT value, cnt, cnt / sum(cnt) OVER () AS frac, CAST(sum(cnt) OVER () - sum(cnt) OVER (ORDER BY value) AS BIGINT) AS cumu_cnt, (sum(cnt) OVER () - sum(cnt) OVER (ORDER BY value)) / sum(cnt) OVER () AS cumu_frac FROM h"


def shares(cuts: tuple[int, ...], prefix: str = "x") -> str:
    return ", ".join(f"coalesce(sum(cnt) FILTER (value {'>' if t == 0 else '>='} {max(t, 0)}), 0) / sum(cnt) * 100 AS {prefix}{t}" for t in cuts)


RANK_MEDIAN = "CAST(coalesce((SELECT min(value) FROM (SELECT value, sum(cnt) OVER (ORDER BY value) AS u, sum(cnt) OVER () AS n FROM {h}) WHERE u >= n // 2 AND n > 1), 0) AS BIGINT)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth.depth_runs(load_reads(spark, sf_dir), intervals.merge(load_targets(spark, sf_dir)))


# --- reads ---------------------------------------------------------------------------------------

FLAGSTAT_SQL = f"""SELECT count(*) AS n_reads, CAST(sum(l_qseq) AS BIGINT) AS n_data, count(*) FILTER ((flag & 512) <> 0) AS n_qcfail,
 count(*) FILTER (ok AND (flag & 1) <> 0) AS n_pair_all, count(*) FILTER (ok AND (flag & 1) <> 0 AND (flag & 2) <> 0 AND (flag & 4) = 0) AS n_pair_good,
 count(*) FILTER (ok AND (flag & 1) <> 0 AND (flag & 64) <> 0) AS n_read1, count(*) FILTER (ok AND (flag & 1) <> 0 AND (flag & 128) <> 0) AS n_read2,
 count(*) FILTER (ok AND (flag & 1) <> 0 AND (flag & 8) <> 0 AND (flag & 4) = 0) AS n_sgltn, count(*) FILTER (ok AND (flag & 1) <> 0 AND (flag & 12) = 0) AS n_pair_map,
 count(*) FILTER (ok AND (flag & 1) <> 0 AND (flag & 12) = 0 AND mchrom <> chrom) AS n_diffchr, count(*) FILTER (ok AND (flag & 4) = 0) AS n_mapped,
 CAST(sum(l_qseq) FILTER (ok AND (flag & 4) = 0) AS BIGINT) AS n_mdata, count(*) FILTER (ok AND (flag & 20) = 16) AS n_mstrand, count(*) FILTER (ok AND (flag & 20) = 0) AS n_pstrand,
 count(*) FILTER (ok AND (flag & 1028) = 1024) AS n_dup, count(*) FILTER (mapq >= 20) AS n_qual,
 count(*) FILTER (((flag & 512) <> 0 OR (flag & 1028) = 0) AND (flag & 64) <> 0) AS n_rmdup1, count(*) FILTER (((flag & 512) <> 0 OR (flag & 1028) = 0) AND (flag & 128) <> 0) AS n_rmdup2
FROM (SELECT *, (flag & 512) = 0 AS ok FROM p)"""


@query(f"WITH {R} {FLAGSTAT_SQL}")
def flagstat(spark, sf_dir):
    return reads_ops.flagstat(load_reads(spark, sf_dir))


@query(f"WITH {R}, c AS ({FLAGSTAT_SQL}) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, {a} / nullif({b}, 0) * 100 AS pct FROM c" for n, a, b in reads_ops.FRACTIONS))
def flag_fractions(spark, sf_dir):
    return reads_ops.flag_fractions(reads_ops.flagstat(load_reads(spark, sf_dir)))


@query(f"{IS} SELECT * FROM h")
def isize_hist(spark, sf_dir):
    return reads_ops.insert_sizes(load_reads(spark, sf_dir), LIMIT)


@query(f"{IS} {CUMULATIVE}")
def isize_cumulative(spark, sf_dir):
    return coverage.cumulative(reads_ops.insert_sizes(load_reads(spark, sf_dir), LIMIT))


@query(f"{IS} SELECT sum(value * cnt) / sum(cnt) AS mean, {RANK_MEDIAN.format(h='h')} AS median FROM h")
def isize_avg_median(spark, sf_dir):
    h = reads_ops.insert_sizes(load_reads(spark, sf_dir), LIMIT)
    return coverage.mean_of(h).crossJoin(F.broadcast(coverage.rank_median(h)))  # one row each


@query(f"WITH {R} SELECT chrom, flag, CASE WHEN (flag & 512) <> 0 THEN 0 WHEN (flag & 4) <> 0 THEN -3 WHEN (flag & 1024) <> 0 THEN 2 ELSE 1 END AS class, count(*) AS n FROM p GROUP BY ALL")
def read_classes(spark, sf_dir):
    return load_reads(spark, sf_dir).filter(flags.primary()).groupBy("chrom", "flag", flags.read_class().alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {R} SELECT chrom, pos, flag, span_end FROM p")
def cigar_end(spark, sf_dir):
    return load_reads(spark, sf_dir).filter(flags.primary()).select("chrom", "pos", "flag", cigar.reference_end(F.col("pos"), F.col("cigar")).alias("span_end"))


@query(f"WITH {R} SELECT chrom, pos, CAST(m1+m2 AS INT) AS qlen FROM p")
def cigar_qlen(spark, sf_dir):
    return load_reads(spark, sf_dir).filter(flags.primary()).select("chrom", "pos", cigar.query_length(F.col("cigar")).alias("qlen"))


@query(f"WITH {R}, ec AS (SELECT *, true AS c FROM e), {SEG} SELECT chrom, b AS beg, e AS end_, CAST(raw AS BIGINT) AS raw, count(*) AS n FROM s GROUP BY ALL")
def cigar_segments(spark, sf_dir):
    return depth.segments(load_reads(spark, sf_dir)).groupBy("chrom", "beg", "end_", F.col("raw").cast("bigint").alias("raw")).agg(F.count("*").alias("n"))


def _near(zone: str) -> str:
    return f"EXISTS (SELECT 1 FROM {zone} k WHERE k.chrom = e.chrom AND k.beg < e.span_end AND e.pos < k.end_)"


@query(f"WITH {R}, {M} SELECT chrom, pos, flag, mapq, isize FROM e WHERE {_near('m')}")
def target_reads(spark, sf_dir):
    return reads_ops.overlapping(reads_ops.depth_eligible(load_reads(spark, sf_dir)), intervals.merge(load_targets(spark, sf_dir))).select("chrom", "pos", "flag", "mapq", "isize")


@query(f"WITH {R}, {FL} SELECT chrom, pos, flag, mapq, isize FROM e WHERE {_near('f')}")
def flank_reads(spark, sf_dir):
    zone = flank_set(load_targets(spark, sf_dir), load_contigs(spark), Options())
    return reads_ops.overlapping(reads_ops.depth_eligible(load_reads(spark, sf_dir)), zone).select("chrom", "pos", "flag", "mapq", "isize")


@query(f"WITH {R}, {M} SELECT chrom, pos, flag, mapq, isize FROM e WHERE NOT {_near('m')}")
def offtarget_reads(spark, sf_dir):
    return reads_ops.overlapping(reads_ops.depth_eligible(load_reads(spark, sf_dir)), intervals.merge(load_targets(spark, sf_dir)), "left_anti").select("chrom", "pos", "flag", "mapq", "isize")


@query(f"WITH {R} SELECT chrom, pos, flag FROM r WHERE chrom = 'chr2' AND pos < 12000 AND pos+m1+d+n+m2 > 11000")
def region_fetch(spark, sf_dir):
    return reads_ops.fetch_region(load_reads(spark, sf_dir), "chr2", 11_000, 12_000).select("chrom", "pos", "flag")


@query(f"WITH {R}, c AS (SELECT 'chr' || i AS chrom, {CONTIG_LENGTH} AS length FROM range(7) g(i) UNION ALL SELECT '*', 0) SELECT c.chrom, CAST(length AS BIGINT) AS length, count(r.chrom) FILTER ((flag & 4) = 0) AS mapped, count(r.chrom) FILTER ((flag & 4) <> 0) AS unmapped FROM c LEFT JOIN r ON c.chrom = r.chrom GROUP BY ALL")
def idxstats(spark, sf_dir):
    return reads_ops.idxstats(load_reads(spark, sf_dir), load_contigs(spark))


BIN_SQL = "CAST(CASE WHEN {b}//16384 = {l}//16384 THEN 4681+{b}//16384 WHEN {b}//131072 = {l}//131072 THEN 585+{b}//131072 WHEN {b}//1048576 = {l}//1048576 THEN 73+{b}//1048576 ELSE 9 END AS INT)"


@query(f"WITH {R} SELECT chrom, pos, span_end, {BIN_SQL.format(b='pos', l='(span_end-1)')} AS bin FROM p")
def reg2bin(spark, sf_dir):
    spans = reads_ops.with_span(load_reads(spark, sf_dir).filter(flags.primary()))
    return spans.select("chrom", "pos", "span_end", bins.region_bin(F.col("pos"), F.col("span_end")).alias("bin"))


@query(f"WITH {T}, l AS (SELECT chrom, beg, end_, unnest([0, 1, 9, 73, 585] || range(4681 + beg//16384, 4682 + (end_-1)//16384)) AS bin FROM t) SELECT chrom, beg, end_, CAST(bin AS INT) AS bin FROM l")
def reg2bins(spark, sf_dir):
    return load_targets(spark, sf_dir).select("chrom", "beg", "end_", F.explode(bins.region_bins(F.col("beg"), F.col("end_"))).alias("bin"))


@query(f"WITH {R}, a AS (SELECT chrom, pos, pos+m1+d+n+m2 AS span_end FROM r) SELECT chrom, {BIN_SQL.format(b='pos', l='(span_end-1)')} AS bin, count(*) AS n, min(pos) AS min_pos, max(span_end) AS max_end FROM a GROUP BY ALL")
def bin_index(spark, sf_dir):
    return reads_ops.bin_index(load_reads(spark, sf_dir))


@query(f"WITH {R}, a AS (SELECT chrom, pos, unnest(range(pos//16384, (pos+m1+d+n+m2-1)//16384 + 1)) AS w FROM r) SELECT chrom, CAST(w AS INT) AS \"window\", min(pos) AS first_pos FROM a GROUP BY ALL")
def linear_index(spark, sf_dir):
    return reads_ops.linear_index(load_reads(spark, sf_dir))


@query("WITH v AS (SELECT user_id % 8 AS u, event_id, CAST(floor(value * 100) AS INT) AS pos FROM events), w AS (SELECT *, lag(pos) OVER (PARTITION BY u ORDER BY event_id) AS before FROM v) SELECT u, event_id, pos FROM w WHERE pos < before")
def sortedness(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 8).alias("u"), "event_id", F.floor(F.col("value") * 100).cast("int").alias("pos"), F.lit("c").alias("chrom"))
    return reads_ops.unsorted_reads(rows, "u", "event_id", 1 << 40).select("u", "event_id", "pos")


@query("""WITH v AS (SELECT user_id % 8 AS u, event_id, 'c' || CAST(CAST(floor(value) AS BIGINT) % 3 AS STRING) AS chrom FROM events), w AS (SELECT *, lag(chrom) OVER (PARTITION BY u ORDER BY event_id) AS before FROM v)
SELECT u, chrom, count(*) AS stretches FROM w WHERE chrom IS DISTINCT FROM before GROUP BY u, chrom HAVING count(*) > 1""")
def contig_stretches(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id % 8 AS u", "event_id", "'c' || CAST(CAST(floor(value) AS BIGINT) % 3 AS STRING) AS chrom", "0 AS pos")
    return reads_ops.split_contigs(rows, "u", "event_id", 1 << 9)


@query(f"WITH {R} SELECT chrom, flag, count(*) AS n FROM r WHERE (flag & 1796) = 0 GROUP BY ALL")
def pileup_reads(spark, sf_dir):
    return load_reads(spark, sf_dir).filter(flags.pileup_ok()).groupBy("chrom", "flag").agg(F.count("*").alias("n"))


@query(f"WITH {R} SELECT chrom, mchrom, count(*) AS n FROM r WHERE chrom < 'chr3' AND mchrom < 'chr3' GROUP BY ALL")
def record_validity(spark, sf_dir):
    number = lambda c: F.substring(c, 4, 2).cast("int")
    rows = load_reads(spark, sf_dir).withColumns({"tid": number("chrom"), "mtid": number("mchrom")}).filter(reads_ops.valid_record(3))
    return rows.groupBy("chrom", "mchrom").agg(F.count("*").alias("n"))


@query(f"WITH {R} SELECT CASE WHEN pos % 5 < 4 THEN 'lib' || CAST(pos % 5 % 2 AS STRING) END AS library, count(*) AS n FROM r GROUP BY 1")
def read_library(spark, sf_dir):
    groups = spark.range(4).selectExpr("'g' || CAST(id AS STRING) AS rg", "'lib' || CAST(id % 2 AS STRING) AS library")
    rows = load_reads(spark, sf_dir).withColumn("rg", F.concat(F.lit("g"), (F.col("pos") % 5).cast("string")))
    return reads_ops.with_library(rows, groups).groupBy("library").agg(F.count("*").alias("n"))


@query("SELECT linenumber, quantity AS kth FROM (SELECT CAST(l_linenumber AS INT) AS linenumber, CAST(l_extendedprice AS DOUBLE) AS quantity, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) AS i FROM lineitem) WHERE i = 100")
def kth_smallest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").cast("int").alias("linenumber"), F.col("l_extendedprice").cast("double").alias("price"))
    return order.kth_smallest(rows, "price", 100, ("linenumber",))


# --- intervals -----------------------------------------------------------------------------------


@query(f"WITH {M} SELECT chrom, beg, end_ FROM m")
def interval_merge(spark, sf_dir):
    return intervals.merge(load_targets(spark, sf_dir))


@query(f"WITH {FL} SELECT chrom, beg, end_ FROM f")
def interval_flank(spark, sf_dir):
    return flank_set(load_targets(spark, sf_dir), load_contigs(spark), Options(flank=FLANK))


@query(f"WITH {M}, {O}, {merged('o', 'n')} SELECT m.chrom, greatest(m.beg, n.beg) AS beg, least(m.end_, n.end_) AS end_ FROM m JOIN n ON m.chrom = n.chrom AND m.beg < n.end_ AND n.beg < m.end_")
def interval_intersect(spark, sf_dir):
    return intervals.intersect(load_targets(spark, sf_dir), load_targets(spark, sf_dir, OTHER_COLUMNS))


@query(f"""WITH {M}, {O}, a AS (SELECT chrom, unnest(range(beg, end_)) AS q FROM m), b AS (SELECT DISTINCT chrom, unnest(range(beg, end_)) AS q FROM o),
k AS (SELECT chrom, q, q - row_number() OVER (PARTITION BY chrom ORDER BY q) AS g FROM a ANTI JOIN b USING (chrom, q)) SELECT chrom, CAST(min(q) AS INT) AS beg, CAST(max(q)+1 AS INT) AS end_ FROM k GROUP BY chrom, g""")
def interval_subtract(spark, sf_dir):
    return intervals.subtract(load_targets(spark, sf_dir), load_targets(spark, sf_dir, OTHER_COLUMNS))


@query(f"WITH {M}, k AS (SELECT chrom, CASE WHEN end_-beg > 50 THEN beg+30 ELSE beg END AS beg, CASE WHEN end_-beg > 50 THEN end_-20 ELSE end_ END AS end_ FROM m), {merged('k', 'q')} SELECT chrom, beg, end_ FROM q")
def interval_trim(spark, sf_dir):
    return intervals.trim(load_targets(spark, sf_dir), 30, 20)


@query(f"WITH {T} SELECT 'one' AS kind, chrom, beg+1 AS beg, end_ FROM t UNION ALL SELECT 'zero', chrom, greatest(beg-1, 0), end_ FROM t")
def interval_base_shift(spark, sf_dir):
    t = load_targets(spark, sf_dir)
    kind = lambda name, df: df.select(F.lit(name).alias("kind"), "chrom", "beg", "end_")
    return kind("one", intervals.to_one_based(t)).unionByName(kind("zero", intervals.to_zero_based(t)))


@query(f"WITH {M}, {O} SELECT chrom, beg, end_ FROM t UNION ALL SELECT chrom, beg, end_ FROM o")
def interval_concat(spark, sf_dir):
    return intervals.concat(load_targets(spark, sf_dir), load_targets(spark, sf_dir, OTHER_COLUMNS))


@query(f"WITH {M} SELECT (SELECT count(*) FROM t) AS raw_regions, CAST((SELECT sum(end_-beg) FROM t) AS BIGINT) AS raw_bases, count(*) AS regions, CAST(sum(end_-beg) AS BIGINT) AS bases, (SELECT count(*) FROM t) - count(*) AS merged_away FROM m")
def interval_stat(spark, sf_dir):
    return intervals.stats(load_targets(spark, sf_dir))


@query(f"WITH {T} SELECT chrom, least(beg, 10000) AS beg, least(end_, 10000) AS end_ FROM t")
def interval_clamp(spark, sf_dir):
    return intervals.clamp(load_targets(spark, sf_dir), load_contigs(spark).withColumn("length", F.lit(10_000)))


@query(f"WITH {T} SELECT chrom, beg, end_, CASE WHEN chrom >= 'chr5' THEN 'unknown_contig' ELSE 'out_of_range' END AS problem FROM t WHERE chrom >= 'chr5' OR end_ > 10000")
def contig_length_bounds(spark, sf_dir):
    short = load_contigs(spark).filter("tid < 5").withColumn("length", F.lit(10_000))
    return intervals.bound_violations(load_targets(spark, sf_dir), short)


@query(f"WITH {R}, {T} SELECT DISTINCT chrom FROM t WHERE chrom NOT IN (SELECT chrom FROM r)")
def missing_contigs(spark, sf_dir):
    return coverage.missing_contigs(load_reads(spark, sf_dir), load_targets(spark, sf_dir))


# --- depth and coverage -----------------------------------------------------------------------------


@query(f"{DEP} SELECT chrom, CAST(q+1 AS INT) AS pos, raw, rmdup, cov FROM dep")
def depth_per_base(spark, sf_dir):
    return depth.per_base(runs(spark, sf_dir))


@query(f"{DEP}, {HIST.format(m='cov')} SELECT * FROM h")
def depth_hist(spark, sf_dir):
    return coverage.histogram(runs(spark, sf_dir))


@query(f"{DEP}, {HIST.format(m='cov')} {CUMULATIVE}")
def depth_cumulative(spark, sf_dir):
    return coverage.cumulative(coverage.histogram(runs(spark, sf_dir)))


@query(f"{DEP}, {HIST.format(m='cov')} SELECT {shares((*coverage.THRESHOLDS, *CUTOFFS))} FROM h")
def coverage_thresholds(spark, sf_dir):
    return coverage.thresholds(coverage.histogram(runs(spark, sf_dir)), CUTOFFS)


@query(f"{DEP}, {HIST.format(m='rmdup')} SELECT {shares(coverage.THRESHOLDS)} FROM h")
def coverage_rmdup(spark, sf_dir):
    return coverage.thresholds(coverage.histogram(runs(spark, sf_dir), "rmdup"))


@query(f"{DEP}, {HIST.format(m='cov')}, k AS (SELECT CAST(sum(value*cnt) AS BIGINT) // (SELECT sum(end_-beg) FROM m) AS a FROM h) SELECT coalesce(sum(cnt) FILTER (value >= floor(a*0.2)), 0) / sum(cnt) * 100 AS u020, coalesce(sum(cnt) FILTER (value >= floor(a*0.5)), 0) / sum(cnt) * 100 AS u050 FROM h, k")
def coverage_uniformity(spark, sf_dir):
    return coverage.uniformity(coverage.histogram(runs(spark, sf_dir)))


@query(f"""{DEP}, {HIST.format(m='cov')}, k AS (SELECT sum(value*cnt) / sum(cnt) AS a FROM h),
q AS (SELECT ord, ratio, max(CAST(floor(ratio * a) AS BIGINT)) OVER (ORDER BY ord) AS threshold FROM k, (VALUES {', '.join(f'({i}, CAST({r} AS DOUBLE))' for i, r in enumerate(RATIOS))}) v(ord, ratio))
SELECT ord, ratio, threshold, coalesce(sum(cnt) FILTER (value > threshold), 0) / sum(cnt) * 100 AS pct FROM h, q GROUP BY ord, ratio, threshold""")
def coverage_ratio(spark, sf_dir):
    return coverage.ratio_coverage(coverage.histogram(runs(spark, sf_dir)), None, RATIOS)


REGIONS = f"{DEP}, g AS (SELECT chrom, beg, end_, sum(raw) / count(*) AS avg, median(raw) AS median, count(*) FILTER (raw > 0) / count(*) * 100 AS cov_pct, count(*) FILTER (cov > 0) / count(*) * 100 AS covfix_pct FROM dep GROUP BY chrom, beg, end_)"


@query(f"{REGIONS} SELECT * FROM g")
def region_stats(spark, sf_dir):
    return coverage.region_stats(runs(spark, sf_dir))


@query(f"{REGIONS} SELECT CAST(floor(avg) AS BIGINT) AS value, count(*) AS cnt FROM g GROUP BY 1")
def region_mean_hist(spark, sf_dir):
    return coverage.region_mean_histogram(coverage.region_stats(runs(spark, sf_dir)))


@query(f"""{DEP}, h AS (SELECT chrom, cov AS value, count(*) AS cnt FROM dep GROUP BY 1, 2),
w AS (SELECT *, sum(cnt) OVER (PARTITION BY chrom ORDER BY value) AS u, sum(cnt) OVER (PARTITION BY chrom) AS n FROM h)
SELECT chrom, coalesce(sum(value*cnt) / nullif((SELECT sum(value*cnt) FROM h), 0) * 100, 0) AS data_pct, sum(value*cnt) / sum(cnt) AS mean,
 CAST(CASE WHEN max(n) > 1 THEN min(value) FILTER (u >= n // 2) ELSE 0 END AS BIGINT) AS median, {shares(coverage.THRESHOLDS)} FROM w GROUP BY chrom""")
def chrom_report(spark, sf_dir):
    return coverage.chrom_report(runs(spark, sf_dir))


@query(f"{FDEP}, {HIST.format(m='raw')} SELECT CAST(sum(cnt) AS BIGINT) AS length, CAST(sum(value*cnt) AS BIGINT) AS data, {shares(coverage.THRESHOLDS)} FROM h")
def flank_stats(spark, sf_dir):
    zone = flank_set(load_targets(spark, sf_dir), load_contigs(spark), Options(flank=FLANK))
    h = coverage.histogram(depth.depth_runs(load_reads(spark, sf_dir), zone), "raw")
    total = h.agg(F.sum("cnt").cast("bigint").alias("length"), F.sum(F.col("value") * F.col("cnt")).cast("bigint").alias("data"))
    return total.crossJoin(F.broadcast(coverage.thresholds(h)))  # one row each


@query(f"{DEP}, l AS (SELECT chrom, beg, q, q - row_number() OVER (PARTITION BY chrom, beg ORDER BY q) AS g FROM dep WHERE cov < {UNCOVER}) SELECT chrom, CAST(min(q) AS INT) AS beg, CAST(max(q)+1 AS INT) AS end_ FROM l GROUP BY chrom, l.beg, g")
def uncover_runs(spark, sf_dir):
    return coverage.uncovered(runs(spark, sf_dir), UNCOVER)


REPORT = Options(cutoffs=CUTOFFS, ratios=RATIOS)


@query(f"{DEP} SELECT concat_ws(chr(9), chrom, q+1, raw, rmdup, cov) AS line FROM dep")
def depth_text(spark, sf_dir):
    lines = sinks.depth_lines(depth.per_base(runs(spark, sf_dir)))
    return lines.select(F.concat_ws("\t", *(F.col(f"`{c}`").cast("string") for c in lines.columns)).alias("line"))


def _report_sql() -> str:
    """The report from parts that are counted base by base."""
    names = "n_reads n_data n_qcfail n_pair_all n_pair_good n_read1 n_read2 n_sgltn n_pair_map n_diffchr n_mapped n_mdata n_mstrand n_pstrand n_dup n_qual n_rmdup1 n_rmdup2".split()
    fdep = bases("f", "fdep").split("z AS", 1)[1]
    fz = fdep.replace("FROM z LEFT", "FROM fz LEFT").replace("z.", "fz.")
    cuts = (*coverage.THRESHOLDS, *CUTOFFS)
    raw = [(c, f"(SELECT {c} FROM c)") for c in names]
    raw += [("target_reads", f"(SELECT count(*) FROM e WHERE {_near('m')})"), ("flank_reads", f"(SELECT count(*) FROM e WHERE {_near('f')})")]
    raw += [("target_data", "(SELECT sum(cov) FROM dep)"), ("target_length", "(SELECT count(*) FROM dep)"), ("rmdup_data", "(SELECT sum(rmdup) FROM dep)"), ("flank_data", "(SELECT sum(raw) FROM fdep)"), ("flank_length", "(SELECT count(*) FROM fdep)")]
    share = lambda table, m, t: f"(SELECT count(*) FILTER ({m} {'>' if t == 0 else '>='} {t}) / count(*) * 100 FROM {table})"
    raw += [(f"{p}x{t}", share(table, m, t)) for p, table, m in (("", "dep", "cov"), ("rmdup_", "dep", "rmdup"), ("flank_", "fdep", "raw")) for t in cuts]
    raw += [(f"u{int(r * 100):03d}", f"(SELECT count(*) FILTER (cov >= floor((SELECT sum(cov) // count(*) FROM dep) * {r})) / count(*) * 100 FROM dep)") for r in (0.2, 0.5)]
    most = lambda i: "greatest(" + ", ".join(f"floor(CAST({r} AS DOUBLE) * (SELECT avg(cov) FROM dep))" for r in RATIOS[: i + 1]) + ")"
    raw += [(f"ratio{i}", f"(SELECT count(*) FILTER (cov > {most(i)}) / count(*) * 100 FROM dep)") for i in range(len(RATIOS))]
    raw += [("regions", "(SELECT count(*) FROM m)"), *((f"regions_x{t}", f"(SELECT count(*) FROM g WHERE value {'>' if t == 0 else '>='} {t})") for t in cuts)]
    raw += [("isize_mean", "(SELECT sum(value*cnt) / sum(cnt) FROM h)"), ("isize_median", RANK_MEDIAN.format(h="h"))]
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS ord, '{x.title}' AS key, CAST({x.value} AS DOUBLE) AS value FROM k" for i, x in enumerate(report_lines(REPORT)))
    parts = f"g AS (SELECT floor(avg(raw)) AS value FROM dep GROUP BY chrom, beg, end_), k AS (SELECT {', '.join(f'{v} AS {n}' for n, v in raw)})"
    return f"WITH {R}, {FL}, {bases('m')}, fz AS{fz}, c AS ({FLAGSTAT_SQL}), h AS (SELECT isize AS value, count(*) AS cnt FROM e WHERE isize > 0 AND isize < {LIMIT} GROUP BY 1), {parts} {rows}"


@query(_report_sql())
def coverage_report_query(spark, sf_dir):
    return coverage_report(load_reads(spark, sf_dir), load_targets(spark, sf_dir), load_contigs(spark), REPORT)


for table in (QUERIES, ORACLE_SQL):
    table["coverage_report"] = table.pop("coverage_report_query")


# --- text forms ---------------------------------------------------------------------------------------

SAM_ROWS = f"WITH {R}, k AS (SELECT *, m1||'M'||CASE WHEN d > 0 THEN d||'D' ELSE '' END||CASE WHEN n > 0 THEN n||'N' ELSE '' END||m2||'M' AS cg FROM p)"


def _alignments(spark, sf_dir):
    return load_reads(spark, sf_dir).filter(flags.primary()).select(F.lit("q").alias("qname"), "*", F.lit(-1).alias("mpos"), F.lit("*").alias("seq"), F.lit("*").alias("qual"), F.lit(None).cast("map<string,struct<type:string,value:string>>").alias("aux"))


@query(f"{SAM_ROWS} SELECT concat_ws(chr(9), 'q', flag, chrom, pos+1, mapq, cg, CASE WHEN mchrom = chrom THEN '=' ELSE mchrom END, 0, isize, '*', '*') AS line, count(*) AS n FROM k GROUP BY 1")
def sam_format(spark, sf_dir):
    return _alignments(spark, sf_dir).select(sinks.sam_line().alias("line")).groupBy("line").agg(F.count("*").alias("n"))


@query(f"{SAM_ROWS} SELECT chrom, pos, flag, mapq, isize, mchrom, cg, count(*) AS n FROM k GROUP BY ALL")
def sam_records(spark, sf_dir):
    """Write alignments as lines and read them again."""
    lines = _alignments(spark, sf_dir).select(sinks.sam_line().alias("value"), F.lit("f").alias("file_idx"))
    return text.sam_rows(lines).groupBy("chrom", "pos", "flag", "mapq", "isize", "mchrom", cigar.format_cigar(F.col("cigar")).alias("cg")).agg(F.count("*").alias("n"))


#: What is wrong with a line of ``sam_problems``, by its position modulo 8.
PROBLEMS = (None, "invalid flag", "invalid number", "invalid CIGAR operation", "unmatched CIGAR operation", "CIGAR and sequence length are inconsistent", "sequence and quality are inconsistent", "missing colon in auxiliary data")


@query(f"WITH {R} SELECT CASE pos % 8 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PROBLEMS) if x)} END AS problem, count(*) AS n FROM r GROUP BY 1")
def sam_problems(spark, sf_dir):
    kind, seq = F.col("pos") % 8, F.repeat(F.lit("A"), F.col("l_qseq"))
    change = lambda i, new, old: F.when(kind == i, new).otherwise(old)
    cg = cigar.format_cigar(F.col("cigar"))
    fields = [
        F.lit("q"), change(1, "9x", F.col("flag").cast("string")), F.col("chrom"), (F.col("pos") + 1).cast("string"), change(2, "x", F.col("mapq").cast("string")),
        F.when(kind == 3, "10Q").when(kind == 4, F.concat(cg, F.lit("3"))).otherwise(cg), F.col("mchrom"), F.lit("0"), F.col("isize").cast("string"), change(5, "A", seq), change(6, "I", F.lit("*")), change(7, "NM3", F.lit("NM:i:1")),
    ]
    return load_reads(spark, sf_dir).select(text.sam_problem(F.concat_ws("\t", *fields)).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query(f"WITH {T} SELECT chrom, beg, CASE p_partkey % 5 WHEN 3 THEN beg+1 ELSE end_ END AS end_ FROM (SELECT *, (beg*31 + end_) % 5 AS p_partkey FROM t) WHERE p_partkey IN (1, 2, 3)")
def bed_parse(spark, sf_dir):
    """Lines of intervals: comments, extra fields, reversed ends, positions and track lines."""
    line = """CASE (beg*31 + end_) % 5 WHEN 0 THEN '# ' || chrom WHEN 1 THEN concat_ws('\\t', chrom, beg, end_, 'x') WHEN 2 THEN concat_ws('  ', chrom, end_, beg) WHEN 3 THEN concat_ws(' ', chrom, beg+1) ELSE 'track name' END AS value"""
    return text.bed_rows(load_targets(spark, sf_dir).selectExpr(line))


@query(f"{SAM_ROWS} SELECT cg, m1+d+n+m2 AS span, count(*) AS n FROM k GROUP BY ALL")
def sam_parse(spark, sf_dir):
    """Format CIGARs and parse them again."""
    text = cigar.format_cigar(F.col("cigar"))
    rows = load_reads(spark, sf_dir).filter(flags.primary()).select(text.alias("cg"), cigar.reference_end(F.lit(0), cigar.parse_cigar(text)).alias("span"))
    return rows.groupBy("cg", "span").agg(F.count("*").alias("n"))


@query(f"WITH {R} SELECT flag, count(*) AS n FROM r GROUP BY 1")
def flag_letter_roundtrip(spark, sf_dir):
    rows = load_reads(spark, sf_dir).select(flags.letters_flag(flags.flag_letters(F.col("flag"))).alias("flag"))
    return rows.groupBy("flag").agg(F.count("*").alias("n"))


@query(f"WITH {T} SELECT chrom || ':' || (beg+1) || '-' || end_ AS region, chrom, beg, end_ FROM t")
def parse_region(spark, sf_dir):
    text = F.concat("chrom", F.lit(":"), (F.col("beg") + 1).cast("string"), F.lit("-"), F.col("end_").cast("string"))
    grouped = F.concat("chrom", F.lit(":"), F.format_number(F.col("beg") + 1, 0), F.lit("-"), F.format_number("end_", 0))
    rows = load_targets(spark, sf_dir).select(text.alias("region"), bins.parse_region(grouped).alias("r"))
    return rows.select("region", "r.chrom", "r.beg", F.col("r.end").alias("end_"))


@query("SELECT 'SQ' AS type, n_name AS name, CAST(n_nationkey + 1000 AS INT) AS length, 'M5:a:b' AS note FROM nation")
def header_parse(spark, sf_dir):
    line = F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), F.col("n_name")), F.concat(F.lit("LN:"), (F.col("n_nationkey") + 1000).cast("string")), F.lit("UR:M5:a:b"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(tags.parse_header(line).alias("h"))
    return rows.select("h.type", F.col("h.tags")["SN"].alias("name"), F.col("h.tags")["LN"].cast("int").alias("length"), F.col("h.tags")["UR"].alias("note"))


@query("SELECT n_name AS name, CAST(n_nationkey + 1000 AS INT) AS length, CASE WHEN n_nationkey < 20 AND n_nationkey % 2 = 1 THEN 'u' END AS ur, CASE WHEN n_nationkey < 20 AND n_nationkey % 5 = 0 THEN 2 WHEN n_nationkey < 20 AND n_nationkey % 2 = 1 THEN 1 ELSE 0 END AS conflict FROM nation UNION ALL SELECT 'a note', NULL, NULL, 0")
def header_merge(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = "concat('@SQ\tSN:', n_name, '\tLN:', {ln}{more}) AS value"
    note = spark.createDataFrame([("@CO\ta note",)], "value string")
    first = nation.selectExpr(line.format(ln="n_nationkey + 1000", more="")).unionByName(note)
    more = ", CASE WHEN n_nationkey % 2 = 1 THEN '\tUR:u' ELSE '' END"
    second = nation.filter("n_nationkey < 20").selectExpr(line.format(ln="CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE n_nationkey + 1000 END", more=more)).unionByName(note)
    t = F.col("tags")
    return text.merge_headers(text.header_lines(first), text.header_lines(second)).select("name", t["LN"].cast("int").alias("length"), t["UR"].alias("ur"), "conflict")


@query("SELECT p_partkey AS k, CAST(p_size + 1 AS BIGINT) AS nm, CAST(NULL AS VARCHAR) AS rg, 'x' || p_size AS xt, 2 AS n, 1 AS kept FROM part")
def aux_edit(spark, sf_dir):
    """Replace, drop, add and keep tags."""
    fields = F.array(F.concat(F.lit("NM:i:"), F.col("p_size").cast("string")), F.concat(F.lit("RG:Z:"), F.col("p_brand")))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", tags.parse_tags(fields).alias("aux"))
    rows = rows.withColumn("aux", tags.put_tag(tags.put_tag(tags.drop_tag(F.col("aux"), "RG"), "NM", "i", F.col("p_size") + 1), "XT", "Z", F.concat(F.lit("x"), F.col("p_size").cast("string"))))
    t = F.col("aux")
    return rows.select(F.col("p_partkey").alias("k"), tags.tag_int(t, "NM").alias("nm"), tags.tag_text(t, "RG").alias("rg"), tags.tag_text(t, "XT").alias("xt"), F.size(t).alias("n"), F.size(tags.keep_tag(t, "NM")).alias("kept"))


@query("SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS nm, p_brand AS rg, CAST(p_retailprice AS DOUBLE) AS xf, CAST(0 AS BIGINT) AS missing FROM part")
def aux_tags(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    fields = F.array(F.concat(F.lit("NM:i:"), F.col("p_size").cast("string")), F.concat(F.lit("RG:Z:"), F.col("p_brand")), F.concat(F.lit("XF:d:"), F.col("p_retailprice").cast("string")))
    rows = part.select("p_partkey", tags.parse_tags(fields).alias("aux"))
    t = F.col("aux")
    return rows.select(F.col("p_partkey").alias("k"), tags.tag_int(t, "NM").alias("nm"), tags.tag_text(t, "RG").alias("rg"), tags.tag_float(t, "XF").alias("xf"), tags.tag_int(t, "ZZ").alias("missing"))
