"""Hierarchical genome bins and region strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the binning scheme: first bin of each level and the shift of its bins' width.
LEVELS = ((4681, 14), (585, 17), (73, 20), (9, 23), (1, 26))
OPEN_END = 1 << 29


def region_bin(beg: Column, end: Column) -> Column:
    """Smallest bin that holds [beg, end)."""
    last = end - 1
    out = None
    for first, shift in LEVELS:
        same = F.shiftright(beg, shift) == F.shiftright(last, shift)
        value = F.shiftright(beg, shift) + first
        out = F.when(same, value) if out is None else out.when(same, value)
    return out.otherwise(0)


def region_bins(beg: Column, end: Column) -> Column:
    """All bins that may hold alignments which overlap [beg, end)."""
    last = end - 1
    parts = [F.sequence(F.shiftright(beg, shift) + first, F.shiftright(last, shift) + first) for first, shift in reversed(LEVELS)]
    return F.when(end > beg, F.flatten(F.array(F.array(F.lit(0)), *parts))).otherwise(F.array().cast("array<int>"))


def parse_region(text: Column) -> Column:
    """(chrom, beg, end) of ``chrom:1,000-2,000``: the last colon divides, 1-based to 0-based, an open end is 2**29."""
    plain = F.regexp_replace(text, "[, ]", "")
    with_range = plain.rlike(":[0-9]+(-[0-9]+)?$")
    first = F.regexp_extract(plain, ":([0-9]+)(-[0-9]+)?$", 1).try_cast("int")
    last = F.regexp_extract(plain, ":[0-9]+-([0-9]+)$", 1).try_cast("int")
    return F.struct(
        F.when(with_range, F.regexp_replace(plain, ":[0-9]+(-[0-9]+)?$", "")).otherwise(plain).alias("chrom"),
        F.when(with_range, F.greatest(first - 1, F.lit(0))).otherwise(0).alias("beg"),
        F.when(with_range, F.coalesce(last, F.lit(OPEN_END))).otherwise(OPEN_END).alias("end"),
    )
