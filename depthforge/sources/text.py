"""Text sources: intervals, alignments, headers, contig lists and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cigar import parse_cigar, query_length
from ..functions.flags import FLAG_LETTERS, UNMAP, parse_flag
from ..functions.tags import parse_header, parse_tags


def read_bed(spark: SparkSession, path: str | list[str], one_based: bool = False, left: int = 0, right: int = 0) -> DataFrame:
    """Intervals (chrom, beg, end_) of BED files or position lists, plain or gzip.

    Fields are divided by white space; a line with two fields is a 1-based position. Reversed
    intervals are swapped, starts are clamped to 0. Comments, ``track`` and ``browser`` lines, blank
    lines and lines without numbers are left out.
    """
    return bed_rows(spark.read.text(path), one_based, left, right)


def bed_rows(lines: DataFrame, one_based: bool = False, left: int = 0, right: int = 0) -> DataFrame:
    """Intervals of ``lines`` (value), as ``read_bed`` takes them."""
    lines = lines.select(F.trim("value").alias("line")).filter(~F.col("line").rlike(r"^(#|track\b|browser\b|$)"))
    f = F.split("line", r"\s+")
    a, b = F.get(f, 1).try_cast("int"), F.get(f, 2).try_cast("int")
    two = F.size(f) == 2
    beg, end = F.when(two, a - 1).otherwise(F.least(a, b)), F.when(two, a).otherwise(F.greatest(a, b))
    shift = F.when(two, 0).otherwise(1 if one_based else 0)
    rows = lines.select(F.get(f, 0).alias("chrom"), (beg - shift).alias("beg"), end.alias("end_")).filter(F.col("beg").isNotNull() & F.col("end_").isNotNull())
    return rows.select("chrom", F.greatest(F.col("beg") - left, F.lit(0)).alias("beg"), (F.col("end_") + right).alias("end_"))


def sam_problem(line: Column) -> Column:
    """What is wrong with a SAM line, null if nothing: the first that holds of the checks below."""
    f = F.split(line, "\t")
    col = lambda i: F.get(f, i)
    number = lambda i: col(i).rlike(r"^-?[0-9]+$")
    tags = F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0)))
    value = lambda t: F.substring(t, F.lit(6), F.length(t))
    kind = lambda t: F.substring(t, 4, 1)
    some = lambda test: F.exists(tags, test)
    with_cigar = col(5) != "*"
    return (
        F.when(F.size(f) < 11, "too few fields")
        .when(~col(1).rlike(rf"^(0[xX][0-9a-fA-F]+|[0-9]+|[{FLAG_LETTERS}]*)$"), "invalid flag")
        .when(~(number(3) & number(4) & number(7) & number(8)), "invalid number")
        .when(with_cigar & ~col(5).rlike(r"^[0-9MIDNSHP=XB]+$"), "invalid CIGAR operation")
        .when(with_cigar & ~col(5).rlike(r"^([0-9]+[MIDNSHP=XB])+$"), "unmatched CIGAR operation")
        .when(with_cigar & (col(9) != "*") & (query_length(parse_cigar(col(5))) != F.length(col(9))), "CIGAR and sequence length are inconsistent")
        .when((col(9) != "*") & (col(10) != "*") & (F.length(col(9)) != F.length(col(10))), "sequence and quality are inconsistent")
        .when(some(lambda t: (F.length(t) < 5) | (F.substring(t, 3, 1) != ":") | (F.substring(t, 5, 1) != ":")), "missing colon in auxiliary data")
        .when(some(lambda t: ~kind(t).isin(*"AaCcSsIifdZHB")), "unrecognized type")
        .when(some(lambda t: kind(t).isin(*"CcSsIi") & ~value(t).rlike(r"^[+-]?[0-9]+$")), "invalid integer")
        .when(some(lambda t: (kind(t) == "H") & (F.length(value(t)) % 2 == 1)), "length of the hex string not even")
        .when(some(lambda t: (kind(t) == "H") & ~value(t).rlike("^[0-9A-Fa-f]*$")), "invalid hex character")
        .when(some(lambda t: (kind(t) == "B") & ~value(t).rlike("^[cCsSiIf](,|$)")), "unrecognized array type")
    )


def invalid_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, problem) of the records of SAM text that break the format."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    return lines.select(F.col("value").alias("line"), sam_problem(F.col("value")).alias("problem")).filter("problem is not null")


def read_sam(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Alignments of SAM text. A record without CIGAR becomes unmapped; positions become 0-based; ``*`` is null.

    ``strict``: a record that breaks the format raises when the plan runs; otherwise its bad fields are null.
    ``file_idx`` is the file of a record.
    """
    return sam_rows(spark.read.text(path).select("value", F.input_file_name().alias("file_idx")), strict)


def sam_rows(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Alignments of ``lines`` (value, file_idx), as ``read_sam`` takes them."""
    lines = lines.filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    if strict:
        wrong = sam_problem(F.col("value"))
        lines = lines.withColumn("value", F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), F.col("value"))).cast("string")).otherwise(F.col("value")))
    f = F.split("value", "\t")
    col = lambda i: F.get(f, i)
    star = lambda c: F.nullif(c, F.lit("*"))
    cigar = parse_cigar(col(5))
    flag = parse_flag(col(1))
    mate = F.when(col(6) == "=", star(col(2))).otherwise(star(col(6)))
    return lines.select(
        "file_idx", col(0).alias("qname"), F.when(F.size(cigar) == 0, flag.bitwiseOR(F.lit(UNMAP))).otherwise(flag).alias("flag"), star(col(2)).alias("chrom"), (col(3).try_cast("int") - 1).alias("pos"), col(4).try_cast("int").alias("mapq"),
        cigar.alias("cigar"), mate.alias("mchrom"), (col(7).try_cast("int") - 1).alias("mpos"), col(8).try_cast("int").alias("isize"), F.length(F.coalesce(star(col(9)), F.lit(""))).alias("l_qseq"),
        col(9).alias("seq"), col(10).alias("qual"), parse_tags(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0)))).alias("aux"),
    )


def header_lines(lines: DataFrame) -> DataFrame:
    """Header lines (type, tags, text, line) of ``lines`` (value); ``line`` is the line as it is."""
    return lines.select(parse_header(F.col("value")).alias("h"), F.col("value").alias("line")).filter("h is not null").select("h.*", "line")


def read_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header lines (type, tags, text, line) of SAM text."""
    return header_lines(spark.read.text(path).filter(F.col("value").startswith("@")))


def header_table(header: DataFrame, kind: str, *tags: str) -> DataFrame:
    """Values of ``tags`` on the header lines of a type, a column each."""
    return header.filter(F.col("type") == kind).select(*(F.col("tags")[t].alias(t) for t in tags))


def header_contigs(header: DataFrame) -> DataFrame:
    """(chrom, length) of the @SQ lines."""
    return header_table(header, "SQ", "SN", "LN").select(F.col("SN").alias("chrom"), F.col("LN").try_cast("int").alias("length")).filter("chrom is not null")


#: Tags that name a header line of each type; fixed values.
HEADER_KEYS = {"HD": "VN", "SQ": "SN", "RG": "ID", "PG": "ID"}


def merge_headers(*headers: DataFrame) -> DataFrame:
    """Lines of all headers, those of one name joined: (type, name, tags, conflict). ``conflict``: 0 one source or equal, 1 tags were added, 2 a tag differs (the first header's stays).

    Comments stay, equal ones once, under their text as the name and without tags.
    """
    every = reduce(DataFrame.unionByName, (h.filter("type <> 'CO'").withColumn("src", F.lit(i)) for i, h in enumerate(headers)))
    name = F.coalesce(*(F.when(F.col("type") == k, F.col("tags")[t]) for k, t in HEADER_KEYS.items()))
    tags = every.select("type", name.alias("name"), "src", F.explode("tags").alias("tag", "value"))
    each = tags.groupBy("type", "name", "tag").agg(F.min_by("value", "src").alias("value"), F.count_distinct("value").alias("kinds"), F.count_distinct("src").alias("srcs"))
    sources = tags.groupBy("type", "name").agg(F.count_distinct("src").alias("all_srcs"))
    joined = each.join(sources, ["type", "name"])
    kind = F.max(F.when(F.col("kinds") > 1, 2).when(F.col("srcs") < F.col("all_srcs"), 1).otherwise(0))
    named = joined.groupBy("type", "name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "value")))).alias("tags"), kind.alias("conflict"))
    comments = reduce(DataFrame.unionByName, (h.filter("type = 'CO'").select("type", F.col("text").alias("name")) for h in headers)).distinct()
    return named.unionByName(comments.select("type", "name", F.lit(None).cast("map<string,string>").alias("tags"), F.lit(0).alias("conflict")))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) of a list ``name<TAB>length``; the same name twice raises when the plan runs."""
    rows = spark.read.csv(path, sep="\t", schema="chrom string, length int")
    n = F.count("*")
    return rows.groupBy("chrom").agg(F.when(n > 1, F.raise_error(F.concat(F.lit("contig named twice: "), F.col("chrom"))).cast("int")).otherwise(F.first("length")).alias("length"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without carriage returns."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))


def n_runs(sequences: DataFrame) -> DataFrame:
    """(chrom, beg, end_) of the runs of ``N`` in ``sequences`` (chrom, offset, seq): pieces of contigs and their offsets."""
    from ..operators.intervals import merge

    gaps = F.transform(F.split("seq", "N+"), lambda x: F.length(x))
    runs = F.transform(F.regexp_extract_all("seq", F.lit("N+"), F.lit(0)), lambda x: F.length(x))
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(runs)).alias("gap"), runs.alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<beg:int,end_:int>>").alias("found"))
    step = lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["found"], F.array(F.struct((s["at"] + x["gap"]).alias("beg"), (s["at"] + x["gap"] + x["size"]).alias("end_")))).alias("found"))
    found = sequences.filter(F.col("seq").contains("N")).select("chrom", "offset", F.explode(F.aggregate(zipped, start, step, lambda s: s["found"])).alias("r"))
    return merge(found.select("chrom", (F.col("offset") + F.col("r.beg")).cast("int").alias("beg"), (F.col("offset") + F.col("r.end_")).cast("int").alias("end_")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, offset, seq) lines of FASTA files.

    Lines are read with the file as one value, as their offsets follow from all lines before them; a
    file should hold one contig at scale.
    """
    files = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.split("value", "(?m)^>"), lambda x: x != "")).alias("record"))
    name = F.regexp_extract("record", r"^(\S+)", 1)
    seq = F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), r"\s", "")
    return files.select(name.alias("chrom"), F.lit(0).alias("offset"), seq.alias("seq"))
