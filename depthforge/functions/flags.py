"""Alignment flag bits, read classes and CIGAR operation sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag bits of the SAM format; fixed values.
PAIRED, PROPER, UNMAP, MUNMAP, REVERSE, MREVERSE, READ1, READ2, SECONDARY, QCFAIL, DUP, SUPP = (1 << i for i in range(12))
#: Letters of the flag bits in their order; fixed values.
FLAG_LETTERS = "pPuUrR12sfdS"
PILEUP_MASK = UNMAP | SECONDARY | QCFAIL | DUP


def has(bit: int, flag: Column | str = "flag") -> Column:
    return (F.col(flag) if isinstance(flag, str) else flag).bitwiseAND(F.lit(bit)) != 0


def primary(flag: str = "flag") -> Column:
    """Neither secondary nor supplementary."""
    return ~has(SECONDARY | SUPP, flag)


def read_class(flag: str = "flag") -> Column:
    """0 QC fail, -3 unmapped, 2 duplicate, else 1; the first that holds."""
    return F.when(has(QCFAIL, flag), 0).when(has(UNMAP, flag), -3).when(has(DUP, flag), 2).otherwise(1)


def pileup_ok(flag: str = "flag") -> Column:
    return ~has(PILEUP_MASK, flag)


def flag_letters(flag: Column) -> Column:
    """Letters of the bits that are set."""
    return F.concat(*(F.when(flag.bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)).otherwise(F.lit("")) for i, c in enumerate(FLAG_LETTERS)))


def letters_flag(letters: Column) -> Column:
    """Inverse of flag_letters."""
    total = F.lit(0)
    for i, c in enumerate(FLAG_LETTERS):
        total = total + F.when(letters.contains(c), 1 << i).otherwise(0)
    return total


def parse_flag(text: Column) -> Column:
    """A flag in decimal, hexadecimal (0x...), octal (0...) or letters."""
    return (
        F.when(text.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(text, 3, 16), 16, 10).cast("int"))
        .when(text.rlike("^0[0-7]+$"), F.conv(text, 8, 10).cast("int"))
        .when(text.rlike("^[0-9]+$"), text.try_cast("int"))
        .otherwise(letters_flag(text))
    )
