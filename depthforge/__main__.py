"""Command line: ``python -m depthforge report|merge|intersect|subtract|trim|shift ...``; all paths are ones that Spark reads.

``-`` is standard input, for alignments in text or binary form and for intervals, and standard output for the latter.
"""

from __future__ import annotations

import argparse
import sys
import tempfile
import uuid
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import coverage, depth, intervals, reads as reads_ops
from .plans.report import Options, coverage_report, report_lines
from .sources import bai, bam, bgzf, sinks, text

#: First bytes of a gzip file; fixed value.
GZIP = b"\x1f\x8b"


def spool_stdin(folder: str) -> str:
    """Copy standard input to a file below ``folder``, which driver and executors share; returns its path.

    The input is copied in pieces, never held whole. Its name tells what its first bytes say: ``.bam`` for
    binary alignments, ``.gz`` for other gzip input.
    """
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    fs.create_dir(at)
    piece = sys.stdin.buffer.read(1 << 20)
    binary = bgzf.is_bgzf(piece) and next(bgzf.blocks(piece))[1][:4] == b"BAM\1"
    name = f"stdin-{uuid.uuid4().hex}{'.bam' if binary else '.gz' if piece[:2] == GZIP else ''}"
    with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
        while piece:
            out.write(piece)
            piece = sys.stdin.buffer.read(1 << 20)
    return f"{folder.rstrip('/')}/{name}"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="depthforge")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("report", help="depth and coverage of targets")
    p.add_argument("inputs", nargs="*", default=["-"], help=".bam or .sam files; - is standard input")
    p.add_argument("-o", "--outdir", required=True)
    p.add_argument("-p", "--bed", required=True)
    p.add_argument("-f", "--flank", type=int, default=200)
    p.add_argument("-q", "--mapthres", type=int, default=20)
    p.add_argument("--maxdepth", type=int)
    p.add_argument("--cutoffdepth", default="")
    p.add_argument("--depthratio", default="")
    p.add_argument("--isize", type=int, default=2000)
    p.add_argument("--uncover", type=int, default=5)
    p.add_argument("--bamout", help="a folder ending in .bam for the reads on targets")
    p.add_argument("-F", "--format", choices=("txt", "csv", "json"), default="txt")
    p.add_argument("-1", dest="one_based", action="store_true", help="the targets are 1-based")
    for name, other, words in (("merge", [], "union"), ("intersect", ["uniq"], "stretches in all sets"), ("subtract", ["diff"], "the first set without the others"), ("trim", [], "shrink intervals"), ("shift", [], "between 0-based and 1-based")):
        p = sub.add_parser(name, aliases=other, help=words)
        p.add_argument("inputs", nargs="*", default=["-"], help="sets of intervals; - is standard input")
        p.add_argument("-o", "--out", default="-", help="a folder of parts; - is standard output")
        p.add_argument("-1", dest="one_based", action="store_true")
        p.add_argument("-l", "--left", type=int, default=0)
        p.add_argument("-r", "--right", type=int, default=0)
        p.add_argument("--to", choices=("0", "1"), default="0")
    top.add_argument("-v", "--version", action="version", version=__version__)
    return top


def alignments(spark: SparkSession, paths: list[str], spool: str) -> tuple[DataFrame, DataFrame]:
    """Reads of all files, and the header of the first."""
    paths = [spool_stdin(spool) if p == "-" else p for p in paths]
    plain, binary = [p for p in paths if not p.endswith(".bam")], [p for p in paths if p.endswith(".bam")]
    for p in binary:
        if "*" not in p and not bai.has_end(p):
            print(f"{p} has no end marker; the file may be cut off", file=sys.stderr)
    sets = ([text.read_sam(spark, plain)] if plain else []) + ([bai.read_bam_splits(spark, binary)] if binary else [])
    header = bam.read_bam_header(spark, paths[0]) if paths[0].endswith(".bam") else text.read_header(spark, paths[0])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets), header


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    """Write all tables of the report below ``--outdir``: reports and distributions as files, depth, regions and uncovered stretches as folders of parts."""
    options = Options.parse(a.cutoffdepth, a.depthratio, flank=a.flank, min_mapq=a.mapthres, isize_limit=a.isize, uncover=a.uncover, max_depth=a.maxdepth)
    if a.bamout and PurePosixPath(a.bamout).suffix != ".bam":
        raise SystemExit("--bamout must end in .bam")
    out = a.outdir.rstrip("/")
    reads, header = alignments(spark, a.inputs, f"{out}/_input")
    contigs = text.header_contigs(header)
    bed = spool_stdin(f"{out}/_input") if a.bed == "-" else a.bed
    targets = intervals.require_in_bounds(text.read_bed(spark, bed, a.one_based), contigs)
    merged = intervals.merge(targets)
    # the runs feed six tables, so they are swept once and written
    depth.depth_runs(reads, merged, a.mapthres).write.mode("overwrite").parquet(f"{out}/_runs")
    runs = spark.read.parquet(f"{out}/_runs")
    # distributions have a line for each depth or size from 0 on
    hist = coverage.cumulative(coverage.dense(coverage.cap(coverage.histogram(runs), options.max_depth)))
    sizes = coverage.cumulative(coverage.dense(reads_ops.insert_sizes(reads, a.isize)))
    chroms = coverage.chrom_report(runs, options.cutoffs)
    long, lines, inputs = coverage_report(reads, targets, contigs, options), report_lines(options), tuple(a.inputs)
    sinks.write_table(sinks.depth_lines(depth.per_base(runs)), f"{out}/depth.tsv.gz")
    sinks.write_table(sinks.region_lines(coverage.region_stats(runs)), f"{out}/region.tsv.gz")
    sinks.write_bed(coverage.uncovered(runs, a.uncover), f"{out}/uncover.bed")
    if a.format == "json":
        document = sinks.report_json(long, lines, inputs, chroms, hist, sizes)
        sinks.write_file(spark.createDataFrame([(document,)], "value string"), f"{out}/report.json")
    else:
        name = lambda what: f"{out}/{sinks.report_name(what, a.format)}"
        sinks.write_file(sinks.report_text(long, lines, a.format, inputs), name("coverage"))
        sinks.write_file(sinks.chromosome_lines(chroms, a.format), name("chromosomes"))
        sinks.write_file(sinks.distribution_lines(hist, a.format, "depth"), name("depth"))
        sinks.write_file(sinks.distribution_lines(sizes, a.format, "size"), name("insertsize"))
    if a.bamout:
        on_target = reads_ops.overlapping(reads_ops.depth_eligible(reads), merged)
        known = [(r["chrom"], r["length"]) for r in contigs.collect()]  # the header's dictionary
        head = "".join(f"{r['line']}\n" for r in header.select("line").collect())
        ids = F.create_map(*(x for i, (c, _) in enumerate(known) for x in (F.lit(c), F.lit(i))))
        number = lambda c: F.coalesce(F.try_element_at(ids, F.col(c)), F.lit(-1))
        rows = on_target.withColumns({"tid": number("chrom"), "mtid": F.when(F.col("mchrom").isNull(), -1).otherwise(number("mchrom"))})
        bam.write_bam(rows, a.bamout if "://" in a.bamout else f"file://{PurePosixPath(a.bamout)}", head, known).collect()


def toolkit(spark: SparkSession, a: argparse.Namespace) -> None:
    with tempfile.TemporaryDirectory() as local:
        spool = spark.conf.get("spark.checkpoint.dir", None) or local  # executors see the former
        sets = [text.read_bed(spark, spool_stdin(spool) if p == "-" else p, a.one_based) for p in a.inputs]
        if a.command == "merge":
            done = intervals.merge(*(intervals.flank(s, a.left, a.right) for s in sets))
        elif a.command in ("intersect", "uniq"):
            done = intervals.intersect(*sets)
        elif a.command in ("subtract", "diff"):
            done = intervals.subtract(*sets)
        elif a.command == "trim":
            done = intervals.trim(intervals.concat(*sets), a.left, a.right)
        else:
            done = (intervals.to_one_based if a.to == "1" else intervals.to_zero_based)(intervals.concat(*sets))
        if a.out == "-":
            for r in done.orderBy("chrom", "beg").toLocalIterator():  # a partition at a time
                print(r["chrom"], r["beg"], r["end_"], sep="\t")
            return
        sinks.write_bed(done, a.out)
        wrote = spark.read.csv(a.out, sep="\t", schema="chrom string, beg int, end_ int")
        print(wrote.agg(F.count("*").alias("regions"), F.coalesce(F.sum(F.col("end_") - F.col("beg")), F.lit(0)).alias("bases")).first().asDict())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("depthforge").getOrCreate()
    (report if a.command == "report" else toolkit)(spark, a)


if __name__ == "__main__":
    main()
