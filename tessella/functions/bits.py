"""Integer arithmetic that wraps, and little-endian bytes, as Catalyst expressions that are legal under ANSI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW32 = 0xFFFFFFFF


def wrap32(x: Column) -> Column:
    """The low 32 bits of a long as a signed int."""
    return F.shiftright(F.shiftleft(x.cast("long"), 32), 32).cast("int")


def wrapping_add64(a: Column, b: Column) -> Column:
    """a + b modulo 2**64: the halves are added apart, so nothing overflows."""
    a, b = a.cast("long"), b.cast("long")
    low = a.bitwiseAND(F.lit(LOW32)) + b.bitwiseAND(F.lit(LOW32))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(LOW32)))


def mask(width: int) -> int:
    """``width`` ones as a signed long."""
    return -1 if width >= 64 else (1 << width) - 1


def little_endian(data: Column, width: int) -> Column:
    """A binary of 1, 2, 4 or 8 bytes as a signed long.

    ``reverse`` would take the bytes for UTF-8 characters, so pairs of hexadecimal digits are reversed instead.
    """
    digits = F.hex(data)
    number = lambda lo, hi: F.conv(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(lo, hi))]), 16, 10).cast("long")
    if width == 8:
        return F.shiftleft(number(4, 8), 32).bitwiseOR(number(0, 4))
    shift = 64 - 8 * width
    return F.shiftright(F.shiftleft(number(0, width), shift), shift)
