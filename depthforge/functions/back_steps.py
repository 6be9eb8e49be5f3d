"""Removal of backward CIGAR operations (``B``), which re-read reference bases already covered."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cigar import CIGAR, QUERY_OPS
from .flags import UNMAP, has
from .shipping import ship_package

RESULT = f"struct<cigar:{CIGAR},seq:string,qual:string>"


def _agree(one: tuple[str, int], two: tuple[str, int]) -> tuple[str, int]:
    """Base and quality where two readings meet: equal bases keep the better quality, else the better base with the difference."""
    if one[0] == two[0]:
        return one[0], max(one[1], two[1])
    best = two if one[1] < two[1] else one
    return best[0], abs(one[1] - two[1])


def unwind(cigar: list[tuple[str, int]], seq: str, qual: str) -> tuple[list[tuple[str, int]], str, str] | None:
    """Operations, bases and qualities without ``B``; None if a ``B`` comes first or reaches before the read's start.

    A ``B`` at the end is ignored. ``*`` as bases or qualities stays ``*``.
    """
    if cigar and cigar[0][0] == "B":
        return None
    plain_seq, plain_qual = seq in ("", "*"), qual in ("", "*")
    letters = iter([] if plain_seq else seq)
    marks = iter([] if plain_qual else qual)
    read = lambda: (next(letters, "N"), 0 if plain_qual else ord(next(marks, "!")) - 33)
    kept, bases, at = [], [], 0
    for k, (op, size) in enumerate(cigar):
        if op == "B":
            if k == len(cigar) - 1:
                break
            if size > at:
                return None
            del bases[at:]
            at -= size
            while size:  # give back query bases, with what lies between them
                last, n = kept.pop()
                if last in QUERY_OPS:
                    if n > size:
                        kept.append((last, n - size))
                    size -= min(n, size)
            continue
        kept.append((op, size))
        if op in QUERY_OPS:
            for _ in range(size):
                bases[at:at + 1] = [_agree(bases[at], new) if at < len(bases) else new] if (new := read()) else []
                at += 1
    del bases[at:]
    ops = [(op, n) for op, run in groupby(((op, n) for op, n in kept if n), key=lambda x: x[0]) if (n := sum(size for _, size in run))]
    return ops, "*" if plain_seq else "".join(b for b, _ in bases), "*" if plain_qual else "".join(chr(q + 33) for _, q in bases)


def remove_back_steps(reads: DataFrame) -> DataFrame:
    """``reads`` (flag, cigar, seq, qual, l_qseq) with every ``B`` of mapped reads resolved.

    Reads without ``B``, and unmapped ones, stay as they are; no values of theirs go to Python. A read
    whose ``B`` cannot be resolved becomes unmapped and keeps all else. Null bases and qualities count as ``*``.
    """
    ship_package(reads.sparkSession)

    @F.udf(returnType=RESULT, useArrow=True)
    def resolve(cigar, seq, qual):
        if cigar is None:
            return None
        found = unwind([(c["op"], c["len"]) for c in cigar], seq or "*", qual or "*")
        return found and {"cigar": [{"op": op, "len": n} for op, n in found[0]], "seq": found[1], "qual": found[2]}

    back = F.coalesce(F.exists("cigar", lambda c: c["op"] == "B") & ~has(UNMAP), F.lit(False))
    only = lambda c: F.when(back, F.col(c))
    x = reads.withColumn("_found", resolve(only("cigar"), only("seq"), only("qual")))
    good = F.col("_found").isNotNull()
    new = {c: F.when(good, F.col("_found")[c]).otherwise(F.col(c)) for c in ("cigar", "seq", "qual")}
    new["l_qseq"] = F.when(good, F.when(F.col("_found")["seq"] == "*", 0).otherwise(F.length(F.col("_found")["seq"]))).otherwise(F.col("l_qseq"))
    new["flag"] = F.when(back & ~good, F.col("flag").bitwiseOR(F.lit(UNMAP))).otherwise(F.col("flag"))
    return x.select(*(new[c].alias(c) if c in new else F.col(c) for c in reads.columns))
