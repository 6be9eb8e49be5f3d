"""Report and table sinks."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.cigar import format_cigar
from ..functions.flags import flag_letters

PROGRAM = "depthforge"
#: Names of the report files by format; fixed values.
NAMES = {"coverage": ("coverage.report", "coverage.csv"), "chromosomes": ("chromosomes.report", "chromosomes.csv"), "depth": ("depth_distribution.plot", "depth_distribution.csv"), "insertsize": ("insertsize.plot", "insertsize.csv")}


def report_name(what: str, form: str) -> str:
    return NAMES[what][form == "csv"]


def number(value: Column, digits: int) -> Column:
    """Fixed digits; no number is ``N/A``."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), "N/A").otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def depth_lines(bases: DataFrame) -> DataFrame:
    return bases.select(F.col("chrom").alias("#Chr"), F.col("pos").alias("Pos"), F.col("raw").alias("Raw Depth"), F.col("rmdup").alias("Rmdup depth"), F.col("cov").alias("Cover depth"))


def region_lines(regions: DataFrame) -> DataFrame:
    return regions.select(F.col("chrom").alias("#Chr"), F.col("beg").alias("Start"), F.col("end_").alias("Stop"), number(F.col("avg"), 2).alias("Avg depth"), number(F.col("median"), 1).alias("Median"), number(F.col("cov_pct"), 2).alias("Coverage"), number(F.col("covfix_pct"), 2).alias("Coverage(FIX)"))


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated gzip parts."""
    df.write.csv(path, sep="\t", header=header, compression="gzip")


def write_bed(df: DataFrame, path: str) -> None:
    df.select("chrom", "beg", "end_").write.csv(path, sep="\t", header=False)


def report_text(report: DataFrame, lines: list, form: str = "txt", inputs: tuple[str, ...] = ()) -> DataFrame:
    """(value) lines of a report (ord, key, value) whose forms are in ``lines``, under a head of three lines.

    txt: titles right-aligned at 60 and a tab; csv: title and value.
    """
    shape = F.lit("".join(x.form for x in lines))
    kind = F.substring(shape, F.col("ord") + 1, F.lit(1))
    shown = F.when(kind == "d", number(F.col("value"), 0)).when((kind == "p") & F.col("value").isNotNull(), F.concat(number(F.col("value"), 2), F.lit("%"))).otherwise(number(F.col("value"), 2))
    line = F.concat(F.lpad("key", F.greatest(F.length("key"), F.lit(60)), F.lit(" ")), F.lit("\t"), shown) if form == "txt" else F.concat_ws(",", "key", shown)
    names = " ".join(inputs)
    head = [f"## The file was created by {PROGRAM}", f"## Version : {__version__}", f"## Files : {names}"] if form == "txt" else [f"# program: {PROGRAM}", f"# version: {__version__}", f"# files: {names}"]
    body = report.select("ord", line.alias("value")).unionByName(report.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "ord int, value string"))
    return body.orderBy("ord").select("value")


def distribution_lines(cumulative: DataFrame, form: str, what: str) -> DataFrame:
    """(value) lines of a dense cumulative histogram, in order; csv has a head with ``what`` as its first name."""
    sep = "," if form == "csv" else "\t"
    cells = [F.col("value").cast("string"), F.col("cnt").cast("string"), number(F.col("frac"), 6), F.col("cumu_cnt").cast("string"), number(F.col("cumu_frac"), 6)]
    body = cumulative.select(F.col("value").cast("bigint").alias("at"), F.concat_ws(sep, *cells).alias("value"))
    if form == "csv":
        body = body.unionByName(body.sparkSession.createDataFrame([(-1, f"{what},count,fraction,cumulative_count,cumulative_fraction")], "at bigint, value string"))
    return body.orderBy("at").select("value")


def chromosome_lines(chroms: DataFrame, form: str) -> DataFrame:
    """(value) lines of a chromosome report, by name under a head; txt has columns of fixed width."""
    cuts = [c for c in chroms.columns if c[0] == "x"]
    wide, sep = form == "txt", "," if form == "csv" else "\t"
    cell = lambda c, n, digits: F.format_string(f"%{n}.{digits}f" if wide and n else f"%.{digits}f", F.col(c).cast("double"))
    cells = [F.format_string("%11s", "chrom") if wide else F.col("chrom"), cell("data_pct", 8, 2), cell("mean", 8, 2), cell("median", 9, 1), *(cell(c, 8 if i < 5 else 0, 2) for i, c in enumerate(cuts))]
    names = ["DATA(%)", "Avg depth", "Median", "Coverage%", *(f"Cov {c[1:]}x %" for c in cuts[1:])]
    head = "\t".join([f"{'#Chromosome':>11}", *(f"{n:>10}" if i < 8 else n for i, n in enumerate(names))]) if wide else ",".join(["Chromosome", *names])
    body = chroms.select(F.lit(1).alias("ord"), "chrom", F.concat_ws(sep, *cells).alias("value"))
    return body.unionByName(chroms.sparkSession.createDataFrame([(0, "", head)], "ord int, chrom string, value string")).orderBy("ord", "chrom").select("value")


def write_file(lines: DataFrame, path: str) -> None:
    """Write a table of few lines as one text file, by way of a folder beside it, on any file system that Spark writes to."""
    spark = lines.sparkSession
    made = f"{path}.parts-{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(made)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, to = hadoop.Path(made), hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    fs.delete(to, True)
    fs.rename(part, to)
    fs.delete(folder, True)


def report_json(report: DataFrame, lines: list, inputs: tuple[str, ...] = (), chromosomes: DataFrame | None = None, depths: DataFrame | None = None, sizes: DataFrame | None = None) -> str:
    """One document of the report, sections by the places in ``lines``, and of three small tables; what is no number becomes null."""

    def plain(v, digits: int | None = None):
        if v is None or isinstance(v, float) and not math.isfinite(v):
            return None
        return int(v) if digits == 0 else round(v, digits) if digits and isinstance(v, float) else v

    out: dict = {"program": PROGRAM, "version": __version__, "input_files": list(inputs)}
    for r in report.orderBy("ord").collect():  # a row for each line of the report
        *sections, name = lines[r["ord"]].path.split("/")
        at = out
        for section in sections:
            at = at.setdefault(section, {})
        at[name] = plain(r["value"], 0 if lines[r["ord"]].form == "d" else 2)
    if chromosomes is not None:
        names = {"chrom": "name", "data_pct": "data_pct", "mean": "avg_depth", "median": "median", "x0": "coverage"}
        out["chromosomes"] = [{names.get(k, f"cov_{k[1:]}x"): plain(v, 2) for k, v in r.asDict().items()} for r in chromosomes.orderBy("chrom").collect()]
    for name, key, df in (("depth_distribution", "depth", depths), ("insert_size_distribution", "size", sizes)):
        if df is not None:
            out[name] = [{key: r["value"], "count": r["cnt"], "fraction": plain(r["frac"], 6), "cumulative_count": r["cumu_cnt"], "cumulative_fraction": plain(r["cumu_frac"], 6)} for r in df.orderBy("value").collect()]
    return json.dumps(out, indent=2)


def sam_line(style: str = "dec") -> Column:
    """A SAM line of an alignment; ``style`` of the flag: dec, hex or letters."""
    flag = {"dec": F.col("flag").cast("string"), "hex": F.concat(F.lit("0x"), F.lower(F.hex(F.col("flag").cast("bigint")))), "letters": flag_letters(F.col("flag"))}[style]
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    mate = F.when(F.col("mchrom") == F.col("chrom"), "=").otherwise(star("mchrom"))
    fields = [F.col("qname"), flag, star("chrom"), F.col("pos") + 1, F.col("mapq"), format_cigar(F.col("cigar")), mate, F.col("mpos") + 1, F.col("isize"), star("seq"), star("qual")]
    tags = F.transform(F.map_entries("aux"), lambda e: F.concat_ws(":", e["key"], F.when(e["value"]["type"].isin(*"cCsSI"), "i").otherwise(e["value"]["type"]), e["value"]["value"]))
    return F.array_join(F.concat(F.array(*(f.cast("string") for f in fields)), F.coalesce(tags, F.array().cast("array<string>"))), "\t")
