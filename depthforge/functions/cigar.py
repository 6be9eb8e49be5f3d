"""CIGAR functions over ``array<struct<op:string,len:int>>``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that consume the reference and the query; fixed values of the SAM format.
REFERENCE_OPS, QUERY_OPS, BASE_OPS = "MDN=X", "MIS=X", "M=X"
CIGAR = "array<struct<op:string,len:int>>"
OPS = "MIDNSHP=XB"
#: CIGARs of at most this many operations are walked in compiled code; longer ones by a lambda, which Spark interprets.
SHORT = 4


def parse_cigar(text: Column) -> Column:
    """Array of operations of a CIGAR string; ``*`` and null are empty."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("*")), F.lit(r"([0-9]+)([MIDNSHP=XB])"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"))).cast(CIGAR)


def format_cigar(cigar: Column) -> Column:
    return F.when(F.size(cigar) > 0, F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")).otherwise(F.lit("*"))


def _length(cigar: Column, ops: str, back: bool = False) -> Column:
    one = lambda x: F.when(x["op"].isin(*ops), x["len"]).when((x["op"] == "B") & F.lit(back), -x["len"]).otherwise(0)
    short = reduce(Column.__add__, (one(F.get(cigar, F.lit(i))) for i in range(SHORT)))
    return F.when(F.array_size(cigar) <= SHORT, short).otherwise(F.aggregate(cigar, F.lit(0), lambda a, x: a + one(x)))


def reference_end(pos: Column, cigar: Column) -> Column:
    """0-based exclusive end of the alignment; ``B`` steps back."""
    return pos + _length(cigar, REFERENCE_OPS, back=True)


def query_length(cigar: Column) -> Column:
    return _length(cigar, QUERY_OPS)


def pack_op(op: Column, length: Column) -> Column:
    """Length and operation in one number, ``length << 4 | op``."""
    code = F.coalesce(*(F.when(op == c, i) for i, c in enumerate(OPS)))
    return F.shiftleft(length, 4).bitwiseOR(code)


def unpack_op(packed: Column) -> Column:
    """Inverse of pack_op, as a struct of op and len."""
    code = packed.bitwiseAND(F.lit(15))
    return F.struct(F.coalesce(*(F.when(code == i, F.lit(c)) for i, c in enumerate(OPS))).alias("op"), F.shiftright(packed, 4).alias("len"))


def reference_segments(pos: Column, cigar: Column) -> Column:
    """Array of (beg, end, is_del) of the aligned and deleted stretches; ``N`` moves on and emits nothing."""
    start = F.struct(pos.alias("at"), F.array().cast("array<struct<beg:int,end:int,is_del:boolean>>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        end = state["at"] + F.when(x["op"].isin(*REFERENCE_OPS), x["len"]).otherwise(0)
        piece = F.array(F.struct(state["at"].alias("beg"), end.alias("end"), (x["op"] == "D").alias("is_del")))
        return F.struct(end.alias("at"), F.when(x["op"].isin("M", "=", "X", "D"), F.concat(state["found"], piece)).otherwise(state["found"]).alias("found"))

    return F.aggregate(cigar, start, step, lambda s: s["found"])


def with_events(reads: DataFrame, bits: int) -> DataFrame:
    """``reads`` with ``events``: array of (p, raw, cov), the changes of depth along a read, for a sweep of each bin alone; null elements mean nothing.

    raw: aligned bases; cov: raw and deleted bases. A stretch that goes on into the next bin starts anew at its edge.
    A short CIGAR inside one bin is its whole span less its gaps, two changes for most reads; the others are walked stretch by stretch.
    """
    event = lambda p, raw, cov: F.struct(p.cast("int").alias("p"), raw.cast("int").alias("raw"), cov.cast("int").alias("cov"))
    op = [F.get(F.col("cigar"), F.lit(i)) for i in range(SHORT)]
    moves = [F.when(x["op"].isin(*REFERENCE_OPS), x["len"]).otherwise(0) for x in op]
    stops = {f"_at{i}": reduce(Column.__add__, moves[:i], F.col("pos")) for i in range(1, SHORT + 1)}
    gaps = {f"_gap{i}": F.when(x["op"] == "D", 1).when(x["op"] == "N", 2).otherwise(0) for i, x in enumerate(op)}
    at, gap = [F.col("pos"), *map(F.col, stops)], [F.col(c) for c in gaps]
    one = F.lit(1)
    ends = [event(at[0], one, one), event(at[-1], -one, -one)]
    holes = [F.when(g > 0, event(p, n, F.when(g == 2, n).otherwise(0))) for i, g in enumerate(gap) for p, n in ((at[i], -one), (at[i + 1], one))]

    def stretch(s: Column) -> Column:
        raw, first, last = (~s["is_del"]).cast("int"), F.shiftright(s["beg"], bits), F.shiftright(s["end"], bits)
        edges = F.when(last > first, F.transform(F.sequence(first + 1, last), lambda b: event(F.shiftleft(b, bits), raw, one))).otherwise(F.array().cast("array<struct<p:int,raw:int,cov:int>>"))
        return F.concat(F.array(event(s["beg"], raw, one), event(s["end"], -raw, -one)), edges)

    walked = F.flatten(F.transform(reference_segments(F.col("pos"), F.col("cigar")), stretch))
    inside = (F.array_size("cigar") <= SHORT) & (F.shiftright("pos", bits) == F.shiftright(at[-1], bits))
    whole = reduce(Column.__add__, gap) == 0
    events = F.when(inside & whole, F.array(*ends)).when(inside, F.array(*ends, *holes)).otherwise(walked)
    return reads.withColumns({**stops, **gaps}).withColumn("events", events).drop(*stops, *gaps)
