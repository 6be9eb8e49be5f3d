"""The worked example of FIXTURES.md and small tables for each operator."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import depthforge
from depthforge.functions import bins, cigar, flags, tags
from depthforge.operators import coverage, depth, intervals, order, reads as reads_ops
from depthforge.plans.report import Options, coverage_report, flank_set, report_lines
from depthforge.sources import bam, bgzf, sinks, text
from depthforge.streaming import fold

CONTIGS = [(0, "chrA", 1000), (1, "chrB", 500), (2, "chrC", 300)]
TARGETS = [("chrA", 10, 20), ("chrA", 18, 25), ("chrA", 25, 30), ("chrA", 100, 110), ("chrA", 200, 210), ("chrB", 0, 10), ("chrC", 50, 60), ("chrC", 70, 75)]
READS = [("r1", "chrA", 5, 99, 60, "10M", 150, 10), ("r10", "chrA", 5, 69, 0, "*", 0, 10), ("r2", "chrA", 12, 1123, 60, "10M", 150, 10), ("r3", "chrA", 14, 147, 10, "4M2D6M", -150, 10), ("r4", "chrA", 20, 512, 60, "10M", 0, 10), ("r5", "chrA", 95, 0, 60, "5M3N10M", 0, 15), ("r6", "chrA", 104, 256, 60, "10M", 0, 10), ("r7", "chrA", 120, 0, 30, "10M", 0, 10), ("r8", "chrB", 0, 0, 60, "5M", 0, 5), ("r9", None, -1, 4, 0, "*", 0, 10)]


@pytest.fixture(scope="module")
def golden(spark):
    contigs = spark.createDataFrame(CONTIGS, "tid int, chrom string, length int")
    targets = spark.createDataFrame(TARGETS, "chrom string, beg int, end_ int")
    rows = spark.createDataFrame(READS, "qname string, chrom string, pos int, flag int, mapq int, cg string, isize int, l_qseq int")
    reads = rows.withColumn("cigar", cigar.parse_cigar(F.col("cg"))).withColumn("mchrom", F.col("chrom"))
    return reads, targets, contigs


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def hist(df):
    return {r["value"]: r["cnt"] for r in df.collect()}


def iv(spark, data):
    return spark.createDataFrame(data, "chrom string, beg int, end_ int")


def test_golden_counters(golden):
    r = reads_ops.flagstat(golden[0]).first()
    want = {"n_reads": 9, "n_data": 90, "n_qcfail": 1, "n_pair_all": 4, "n_pair_good": 3, "n_mapped": 6, "n_mdata": 60, "n_pair_map": 3, "n_read1": 3, "n_read2": 1, "n_pstrand": 5, "n_mstrand": 1, "n_dup": 1, "n_qual": 6, "n_rmdup1": 1, "n_rmdup2": 1}
    assert {k: r[k] for k in want} == want
    assert hist(reads_ops.insert_sizes(golden[0])) == {150: 2}


def test_golden_depth(golden):
    reads, targets, contigs = golden
    merged = intervals.merge(targets)
    assert rows(merged) == [("chrA", 10, 30), ("chrA", 100, 110), ("chrA", 200, 210), ("chrB", 0, 10), ("chrC", 50, 60), ("chrC", 70, 75)]
    flanks = flank_set(targets, contigs, Options(flank=5))
    assert rows(flanks) == [("chrA", 5, 35), ("chrA", 95, 115), ("chrA", 195, 215), ("chrB", 0, 15), ("chrC", 45, 80)]
    eligible = reads_ops.depth_eligible(reads)
    assert reads_ops.overlapping(eligible, merged).count() == 6 == reads_ops.overlapping(eligible, flanks).count()
    assert rows(reads_ops.overlapping(eligible, merged, "left_anti"), "qname") == [("r7",)]
    runs = depth.depth_runs(reads, merged)
    assert hist(coverage.histogram(runs)) == {0: 33, 1: 18, 2: 11, 3: 3}
    assert hist(coverage.histogram(runs, "rmdup")) == {0: 38, 1: 27}
    assert hist(coverage.histogram(runs, "raw")) == {0: 33, 1: 20, 2: 9, 3: 3}
    assert hist(coverage.histogram(depth.depth_runs(reads, flanks), "raw")) == {0: 75, 1: 33, 2: 9, 3: 3}
    base = [(r["pos"], r["raw"], r["rmdup"], r["cov"]) for r in depth.per_base(runs).filter("chrom = 'chrA' and pos <= 30").orderBy("pos").collect()]
    want = "1,1,1 1,1,1 2,1,2 2,1,2 3,1,3 2,0,2 2,0,2 2,0,2 1,0,2 1,0,2 3,1,3 3,1,3 2,1,2 2,1,2 2,1,2 2,1,2 1,1,1 1,1,1 1,1,1 1,1,1".split()
    assert [f"{a},{b},{c}" for _, a, b, c in base] == want and depth.per_base(runs).count() == 65
    regions = {(r["chrom"], r["beg"]): (r["avg"], r["median"], r["cov_pct"], r["covfix_pct"]) for r in coverage.region_stats(runs).collect()}
    assert regions["chrA", 10] == (1.75, 2.0, 100, 100) and regions["chrB", 0] == (0.5, 0.5, 50, 50) and regions["chrC", 70] == (0, 0, 0, 0)
    assert hist(coverage.region_mean_histogram(coverage.region_stats(runs))) == {0: 5, 1: 1}
    assert rows(coverage.uncovered(runs, 2)) == [("chrA", 10, 12), ("chrA", 26, 30), ("chrA", 100, 110), ("chrA", 200, 210), ("chrB", 0, 10), ("chrC", 50, 60), ("chrC", 70, 75)]
    assert rows(coverage.missing_contigs(reads, targets)) == [("chrC",)]


def test_golden_report(golden, tmp_path):
    options = Options(flank=5, uncover=2, cutoffs=(2,), ratios=(0.5, 0.25))
    report, lines = coverage_report(*golden, options), report_lines(options)
    values = {r["key"]: r["value"] for r in report.collect()}
    assert [values[x.title] for x in lines if x.path in ("target/region_len", "target/region_count", "target/reads", "flank/reads", "flank/region_len", "target/regions_covered_gt_0x")] == [6, 65, 6, 1, 120, 6]
    assert values["[Target] Target Data(Mb)"] == 49e-6 and values["[flank] flank Data(Mb)"] == 60e-6
    assert values["[Target] Coverage (>=2x)"] == 14 / 65 * 100 and values["[Target] Coverage(rmdup) (>0x)"] == 27 / 65 * 100
    # the mean depth is 49 / 65, so all thresholds that hang on it are 0
    assert values["[Target] Coverage (>0.2*(Average depth)x)"] == 100 and values["[Target] Coverage (>0.50*Avg)"] == values["[Target] Coverage (>0.25*Avg)"] == 32 / 65 * 100
    got = [r["value"] for r in sinks.report_text(report, lines, "txt", ("a.bam",)).collect()]
    assert got[:3] == ["## The file was created by depthforge", f"## Version : {depthforge.__version__}", "## Files : a.bam"]
    assert got[3] == "[Total] Raw Reads (All reads)".rjust(60) + "\t9" and "[Total] Fraction of Mapped Reads".rjust(60) + "\t66.67%" in got and "[Insert size] Average".rjust(60) + "\t150.00" in got
    csv = [r["value"] for r in sinks.report_text(report, lines, "csv").collect()]
    assert len(csv) == len(lines) + 3 and "[Target] Average depth,0.75" in csv
    made = json.loads(sinks.report_json(report, lines, ("a.bam",)))
    assert made["reads"]["total"] == 9 and made["target"]["coverage"]["ge_2x"] == 21.54 and made["target"]["coverage_ratio"] == {"gt_0.50_avg": 49.23, "gt_0.25_avg": 49.23} and made["flank"]["region_len"] == 120
    empty = coverage_report(golden[0].limit(0), *golden[1:], Options())
    assert "[Total] Fraction of Mapped Reads,N/A" in [r["value"] for r in sinks.report_text(empty, report_lines(Options()), "csv").collect()]
    sinks.write_table(sinks.region_lines(coverage.region_stats(depth.depth_runs(golden[0], golden[1].limit(0)))), str(tmp_path / "r"))


def test_failed_and_unmapped(golden, spark):
    """A placed read that failed QC counts on targets, on flanks and in the insert sizes, mapped or not."""
    schema = "qname string, chrom string, pos int, flag int, mapq int, cg string, isize int, l_qseq int"
    rows_ = spark.createDataFrame([("a", "chrA", 15, 512 + 4, 60, "10M", 77, 10), ("b", "chrA", 15, 4, 60, "10M", 78, 10), ("c", None, -1, 512 + 4, 60, "*", 79, 10)], schema)
    reads = rows_.withColumn("cigar", cigar.parse_cigar(F.col("cg"))).withColumn("mchrom", F.col("chrom"))
    assert rows(reads_ops.depth_eligible(reads), "qname") == [("a",)] and hist(reads_ops.insert_sizes(reads)) == {77: 1}
    assert rows(reads_ops.overlapping(reads_ops.depth_eligible(reads), intervals.merge(golden[1])), "qname") == [("a",)]
    assert {r["size"]: r["cnt"] for r in reads_ops.counters_by_size(reads).collect()} == {0: 2, 77: 1}


def test_long_spans(spark):
    """Reads with gaps longer than a bin, against brute force; repeated rows stay as many as they are."""
    rng = random.Random(3)
    spans = [(rng.randrange(0, 3000), rng.choice([0, 0, 40, 200, 1500])) for _ in range(200)] * 2
    reads = spark.createDataFrame([("c", p, f"5M{n}N5M" if n else "10M") for p, n in spans], "chrom string, pos int, cg string").withColumn("cigar", cigar.parse_cigar(F.col("cg")))
    zones = [(b, b + rng.randrange(1, 30)) for b in rng.sample(range(0, 5000, 40), 25)]
    near = lambda p, n: any(p < e and b < p + 10 + n for b, e in zones)
    for how, keep in (("left_semi", True), ("left_anti", False)):
        got = reads_ops.overlapping(reads, iv(spark, [("c", b, e) for b, e in zones]), how, bits=6)
        assert got.columns == reads.columns and sorted(r["pos"] for r in got.collect()) == sorted(p for p, n in spans if near(p, n) == keep)


def test_intervals_by_brute_force(spark):
    rng = random.Random(4)
    make = lambda: [(rng.choice("xy"), b := rng.randrange(40_000), b + rng.randrange(0, 900)) for _ in range(60)]
    a, b = make(), [*make(), ("x", 16_000, 50_000)]
    cover = lambda s: {(c, p) for c, x, y in s for p in range(x, y)}

    def spans(bases):
        out = []
        for c, p in sorted(bases):
            if out and out[-1][0] == c and out[-1][2] == p:
                out[-1][2] = p + 1
            else:
                out.append([c, p, p + 1])
        return sorted(map(tuple, out))

    da, db = iv(spark, a), iv(spark, b)
    assert rows(intervals.merge(da)) == spans(cover(a))
    assert rows(intervals.merge(da, db)) == spans(cover(a) | cover(b))
    assert rows(intervals.intersect(da, db)) == spans(cover(a) & cover(b))
    assert rows(intervals.subtract(da, db)) == spans(cover(a) - cover(b))


@pytest.mark.parametrize("a, b, both, less", [([("c", 0, 100)], [("c", 50, 60)], [("c", 50, 60)], [("c", 0, 50), ("c", 60, 100)]), ([("c", 0, 10), ("c", 20, 30)], [("c", 5, 25)], [("c", 5, 10), ("c", 20, 25)], [("c", 0, 5), ("c", 25, 30)]), ([("x", 0, 5)], [("y", 0, 5)], [], [("x", 0, 5)]), ([("c", 0, 10)], [("c", 0, 10)], [("c", 0, 10)], [])])
def test_interval_cases(spark, a, b, both, less):
    assert rows(intervals.intersect(iv(spark, a), iv(spark, b))) == both
    assert rows(intervals.subtract(iv(spark, a), iv(spark, b))) == less


def test_interval_edges(spark):
    assert rows(intervals.trim(iv(spark, [("c", 10, 20)]), 2, 3)) == [("c", 12, 17)]
    assert rows(intervals.trim(iv(spark, [("c", 10, 14)]), 2, 3)) == [("c", 10, 14)]
    assert rows(intervals.merge(iv(spark, [("c", 5, 5)]))) == [] == rows(intervals.merge(iv(spark, [])))
    s = intervals.stats(iv(spark, [("c", 0, 5), ("c", 5, 9)])).first()
    assert (s["raw_regions"], s["regions"], s["bases"], s["merged_away"]) == (2, 1, 9, 1)
    short = spark.createDataFrame([("c", 8)], "chrom string, length int")
    assert rows(intervals.clamp(iv(spark, [("c", 5, 9)]), short)) == [("c", 5, 8)]
    with pytest.raises(Exception, match="out of range"):
        intervals.require_in_bounds(iv(spark, [("c", 5, 9)]), short).collect()


def test_cigar(spark):
    df = spark.createDataFrame([("10M",), ("4M2D6M",), ("5M3N10M",), ("3S5M2I4M",), ("5=1X4M",), ("*",)], "cg string").withColumn("c", cigar.parse_cigar(F.col("cg")))
    got = df.select(cigar.reference_end(F.lit(100), F.col("c")), cigar.query_length(F.col("c")), cigar.format_cigar(F.col("c")), F.size(cigar.reference_segments(F.lit(100), F.col("c")))).collect()
    assert [tuple(r) for r in got] == [(110, 10, "10M", 1), (112, 10, "4M2D6M", 3), (118, 15, "5M3N10M", 2), (109, 14, "3S5M2I4M", 2), (110, 10, "5=1X4M", 3), (100, 0, "*", 0)]
    packed = df.limit(1).select(cigar.pack_op(F.col("c")[0]["op"], F.col("c")[0]["len"]).alias("p")).select("p", cigar.unpack_op(F.col("p")).alias("u")).first()
    assert packed["p"] == 160 and tuple(packed["u"]) == ("M", 10)


def test_functions(spark):
    one = spark.range(1)
    r = lambda s: tuple(one.select(bins.parse_region(F.lit(s)).alias("r")).first()["r"])
    assert r("chr1:1,000-2,000") == ("chr1", 999, 2000) and r("chr1") == ("chr1", 0, 1 << 29) and r("a:b:7") == ("a:b", 6, 1 << 29)
    assert one.select(bins.region_bins(F.lit(0), F.lit(1)).alias("b")).first()["b"] == [0, 1, 9, 73, 585, 4681]
    flag = lambda x: one.select(flags.parse_flag(F.lit(x)).alias("f")).first()["f"]
    assert [flag(x) for x in ("99", "0x63", "0143", "pP1")] == [99, 99, 99, 67]
    aux = F.split(F.lit("NM:i:3,RG:Z:lib1,AS:i:-5,XF:f:1.5,XA:A:c,XH:H:1AE3"), ",")
    t = tags.parse_tags(F.concat(aux, F.array(F.lit("ZB:B:c,1,2,-3"), F.lit("NM:i:9"))))
    got = one.select(t.alias("t")).select(tags.tag_int(F.col("t"), "NM"), tags.tag_int(F.col("t"), "AS"), tags.tag_float(F.col("t"), "XF"), tags.tag_char(F.col("t"), "XA"), tags.tag_text(F.col("t"), "RG"), tags.tag_array(F.col("t"), "ZB"), tags.tag_int(F.col("t"), "??"), tags.tag_text(tags.put_tag(F.col("t"), "RG", "Z", F.lit("n")), "RG")).first()
    assert tuple(got) == (3, -5, 1.5, "c", "lib1", [1, 2, -3], 0, "n")
    assert one.select(tags.type_size(F.lit("s")).alias("n")).first()["n"] == 2


def test_histograms(spark):
    h = lambda d: spark.createDataFrame(list(d.items()), "value bigint, cnt bigint")
    for d, mean, med in (({0: 1, 4: 1}, 2, 0), ({1: 1, 3: 2, 9: 1}, 4, 3), ({300: 1}, 300, 0), ({}, None, 0)):
        assert coverage.mean_of(h(d)).first()[0] == mean and coverage.rank_median(h(d)).first()[0] == med
    d = h({0: 2, 2: 3, 4: 5})
    assert [r["pct"] for r in coverage.ratio_coverage(d, 10, (0.5, 1.0)).orderBy("ord").collect()] == [80, 50]
    assert tuple(coverage.uniformity(d, 10).first()) == (100, 80) and tuple(coverage.uniformity(h({}), 0).first()) == (None, None)
    assert hist(coverage.dense(h({2: 1}))) == {0: 0, 1: 0, 2: 1} and hist(coverage.fold(d, d)) == {0: 4, 2: 6, 4: 10}
    with pytest.raises(ValueError):
        Options.parse(ratios="1.5")


def test_text_sources(spark, tmp_path):
    bed = tmp_path / "t.bed"
    bed.write_text("track x\n#c\n\nchrM 649 1603\nc\t20 10 extra\nc 7\nc x y\n")
    assert rows(text.read_bed(spark, str(bed))) == [("c", 6, 7), ("c", 10, 20), ("chrM", 649, 1603)]
    assert ("c", 9, 20) in rows(text.read_bed(spark, str(bed), one_based=True))
    sam = tmp_path / "t.sam"
    sam.write_text("@HD\tVN:1.4\tSO:coordinate\n@SQ\tSN:chrA\tLN:1000\tUR:a:b\n@CO\tx\ty\nq1\t99\tchrA\t6\t60\t10M\t=\t50\t150\tACGTACGTAC\tIIIIIIIIII\tNM:i:3\nq2\t0x0\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    head, reads = text.read_header(spark, str(sam)), text.read_sam(spark, str(sam))
    assert rows(text.header_contigs(head)) == [("chrA", 1000)] and head.filter("type = 'CO'").first()["text"] == "x\ty"
    assert rows(reads, "qname", "flag", "pos", "l_qseq") == [("q1", 99, 5, 10), ("q2", 4, -1, 0)]
    assert reads.filter("qname = 'q1'").select(sinks.sam_line("hex")).first()[0] == "q1\t0x63\tchrA\t6\t60\t10M\t=\t50\t150\tACGTACGTAC\tIIIIIIIIII\tNM:i:3"
    assert {(r["name"], r["conflict"]) for r in text.merge_headers(head, head).collect()} == {("1.4", 0), ("chrA", 0), ("x\ty", 0)}
    assert [r["line"] for r in head.collect()] == sam.read_text().splitlines()[:3]
    assert text.invalid_sam(spark, str(sam)).count() == 0 and text.read_sam(spark, str(sam), strict=True).count() == 2
    good = "q 0 c 6 60 10M * 0 0 ACGTACGTAC IIIIIIIIII".split()
    change = {"too few fields": (10, None), "invalid flag": (1, "9x"), "invalid number": (3, "x"), "invalid CIGAR operation": (5, "10Q"), "unmatched CIGAR operation": (5, "10M3"), "CIGAR and sequence length are inconsistent": (5, "9M"), "sequence and quality are inconsistent": (10, "I"), "missing colon in auxiliary data": (11, "NM3"), "unrecognized type": (11, "NM:q:3"), "invalid integer": (11, "NM:i:x"), "length of the hex string not even": (11, "XH:H:1AE"), "invalid hex character": (11, "XH:H:1G"), "unrecognized array type": (11, "ZB:B:x,1")}
    broken = tmp_path / "b.sam"
    broken.write_text("\n".join("\t".join([x for x in [*good[:i], value, *good[i + 1 :]] if x is not None]) for i, value in change.values()) + "\n")
    assert [r["problem"] for r in text.invalid_sam(spark, str(broken)).collect()] == list(change)
    with pytest.raises(Exception, match="too few fields"):
        text.read_sam(spark, str(broken), strict=True).select("qname").collect()
    fa = tmp_path / "t.fa"
    fa.write_text(">a x\nACNN\nNNGT\nNN\n>b\nACGT\n")
    assert rows(text.n_runs(text.read_fasta(spark, str(fa)))) == [("a", 2, 6), ("a", 8, 10)]


def test_binary_alignments(spark, tmp_path):
    sam = tmp_path / "t.sam"
    sam.write_text("".join(f"q{i}\t0\tchrA\t{i + 1}\t60\t5M1D5M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tNM:i:{i}\tZB:B:c,1,-2\n" for i in range(50)))
    rows_ = text.read_sam(spark, str(sam)).withColumn("tid", F.lit(0)).withColumn("mtid", F.lit(-1))
    out = f"file://{tmp_path}/bam"
    assert sum(r["n"] for r in bam.write_bam(rows_.coalesce(2), out, "@HD\tVN:1.4\n@SQ\tSN:chrA\tLN:1000\n", [("chrA", 1000)]).collect()) == 50
    back = bam.read_bam(spark, out)
    key = ("qname", "pos", "flag", "mapq", "seq", "qual", "l_qseq")
    assert rows(back, *key) == rows(rows_, *key)
    assert back.select(tags.tag_int(F.col("aux"), "NM").alias("n")).agg(F.sum("n")).first()[0] == sum(range(50))
    assert set(rows(text.header_contigs(bam.read_bam_header(spark, out)))) == {("chrA", 1000)}
    data = bgzf.compress(b"x" * 200_000)
    assert b"".join(b for _, b in bgzf.blocks(data)) == b"x" * 200_000 and bgzf.has_eof(data) and bgzf.is_bgzf(data) and not bgzf.is_bgzf(b"no")
    second = next(at for at, _ in bgzf.blocks(data) if at)
    assert len(bgzf.seek(data, second << 16 | 10)) == 200_000 - bgzf.MOST - 10


def test_streaming_fold(spark, golden, tmp_path):
    golden[0].write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(golden[0].schema).parquet(str(tmp_path / "in"))
    fold.fold_insert_sizes(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert hist(fold.folded(spark, str(tmp_path / "out"))) == {150: 2}
    stream = spark.readStream.schema(golden[0].schema).parquet(str(tmp_path / "in"))
    fold.fold_counters(stream, str(tmp_path / "n"), str(tmp_path / "ck2")).awaitTermination(60)
    assert fold.folded_counters(spark, str(tmp_path / "n")).first() == reads_ops.flagstat(golden[0]).first()


def test_order(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9, None)] + [("b", 2)], "g string, v int")
    assert rows(order.kth_smallest(df, "v", 2, ("g",))) == [("a", 1)] and rows(order.kth_smallest(df, "v", 3)) == [(2,)] and order.kth_smallest(df, "v", 9).count() == 0
    many = spark.range(200).coalesce(1)
    once, again = ([r[0] for r in order.shuffled(many, 3).collect()] for _ in range(2))
    assert once == again and once != sorted(once) and sorted(once) == list(range(200))
    some = [r[0] for r in order.sampled(many, 20).collect()]
    assert len(set(some)) == 20 and order.sampled(many, 300).count() == 200


def test_sweep_by_brute_force(spark):
    """Depth of short and long CIGARs, gaps and reads over the edges of bins, against a walk base by base."""
    rng = random.Random(5)
    made = ["".join(f"{rng.randrange(0 if op in 'DN' else 1, 90 if op == 'N' else 12)}{op}" for op in rng.choices("MDNIS=X", (6, 2, 2, 1, 1, 1, 1), k=rng.randrange(1, 9))) for _ in range(150)]
    cigars = [*made, "64M", "5M2D4M", "4M60N4M", "3M1D2N3M", "6M1I6M1D6M2N6M", "300M", "*"]
    reads_ = [("c", rng.choice([0, 63, 64, 128, rng.randrange(600)]), rng.choice([0, 4, 512, 516, 1024, 1536, 256]), rng.choice([0, 60]), cg) for cg in cigars * 2]
    zones, depths = [(0, 40), (60, 70), (128, 500), (640, 641)], {}
    for _, pos, flag, mapq, cg in reads_:
        if flag & 256 or flag & 516 == 4:
            continue
        clean, at = flag & 1540 != 1024 and mapq >= 20, pos
        for n, op in ((int(x[:-1]), x[-1]) for x in cigar_ops(cg)):
            for p in range(at, at + n) if op in "M=XD" else ():
                d = depths.setdefault(p, [0, 0, 0])
                d[0], d[1], d[2] = d[0] + (op != "D"), d[1] + (op != "D" and clean), d[2] + 1
            at += n if op in "MDN=X" else 0
    reads = spark.createDataFrame(reads_, "chrom string, pos int, flag int, mapq int, cg string").withColumn("cigar", cigar.parse_cigar(F.col("cg")))
    runs = depth.depth_runs(reads, iv(spark, [("c", *z) for z in zones]), bits=6)
    assert rows(depth.per_base(runs).drop("chrom")) == [(p + 1, *depths.get(p, (0, 0, 0))) for z in zones for p in range(*z)]
    ends = [tuple(r) for r in reads.select("cg", cigar.reference_end(F.lit(7), F.col("cigar"))).collect()]
    assert ends == [(cg, 7 + sum(int(x[:-1]) for x in cigar_ops(cg) if x[-1] in "MDN=X")) for *_, cg in reads_]


def cigar_ops(cg):
    return re.findall(r"[0-9]+[A-Z=]", cg)


@pytest.mark.parametrize("name, scans", [("coverage_report", 9), ("coverage_ratio", 1), ("coverage_uniformity", 1)])
def test_reads_in_compiled_code(spark, name, scans):
    """Stages that see each read are methods that Java compiles (at most 8000 bytes), and no query runs the sweep ahead of its own run."""
    spark.sparkContext.setJobGroup(name, name)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        plan = query._jdf.queryExecution().executedPlan()
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [x._3().maxMethodCodeSize() for x in map(stages.apply, range(stages.size())) if "l_orderkey" in x._1() and "Exchange" not in x._1()]
    assert sizes and max(sizes) <= 8000
    assert len([x for x in re.sub(r"ReusedExchange.*", "", plan.toString()).split("\n") if "FileScan" in x and "l_orderkey" in x]) <= scans
    assert jobs <= 2  # the schemas of two tables
