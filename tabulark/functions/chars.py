"""CHAR(n) values and the linear-hash bucket functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_fit(value: Column, n: int) -> Column:
    """value cut or padded with spaces to exactly n characters."""
    return F.rpad(value, n, " ")


def char_equal(value: Column, literal: str, n: int, stored: bool = False) -> Column:
    """Equality of a CHAR(n) value and a literal, both fitted to n first.

    A stored CHAR(n) column has its length already: it stays bare, so that the
    comparison is pushed to the scan.
    """
    return (value if stored else char_fit(value, n)) == F.lit(literal[:n].ljust(n))


def char_hash(value: Column) -> Column:
    """The index hash of a CHAR value without the spaces around it: the 31-fold
    polynomial of its characters in 32 bits, the sign bit cleared."""
    codes = F.transform(F.filter(F.split(F.trim(value), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return folded.bitwiseAND(F.lit(0x7FFFFFFF))


def hash_key(value: Column, kind: str) -> Column:
    """The index hash of an INT, BOOLEAN or CHAR value, never negative."""
    if kind == "CHAR":
        return char_hash(value)
    if kind == "BOOLEAN":
        return value.cast("int")
    return value.bitwiseAND(F.lit(0x7FFFFFFF))


def bucket_of(key: Column, level: int, last: int) -> Column:
    """Linear-hash bucket of a hash: its low `level` bits, folded back one level
    if that bucket is beyond `last`."""
    low = key.bitwiseAND(F.lit((1 << level) - 1))
    return F.when(low > last, low - (1 << (level - 1))).otherwise(low)
