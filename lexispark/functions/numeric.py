"""Bit-level forms of numbers: order-preserving doubles, prefix terms, 7-bit packing, byte strings and variable-length integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = -(1 << 63)


def sortable_long(x: Column) -> Column:
    """The bits of a double so turned that their unsigned order is the order of the numbers; null stays null."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x).cast("bigint")
    return F.when(x.isNull(), None).otherwise(F.when(bits >= 0, bits.bitwiseXOR(F.lit(_SIGN))).otherwise(F.bitwise_not(bits)))


def sortable_double(y: Column) -> Column:
    """The inverse of ``sortable_long``."""
    bits = F.when(y < 0, y.bitwiseXOR(F.lit(_SIGN))).otherwise(F.bitwise_not(y))
    return F.when(y.isNull(), None).otherwise(F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double"))


def long_mask(length: int) -> int:
    """A signed 64-bit mask of the highest ``length`` bits."""
    kept = min(length, 64)
    mask = ((1 << 64) - 1) ^ ((1 << (64 - kept)) - 1)
    return mask - (1 << 64) if mask >> 63 else mask


def prefix_terms(bits: Column, step: int) -> Column:
    """Array of (shift, prefix): the highest step, 2 x step, ... bits of a number, as legacy range indexes stored them."""
    return F.array(*[F.struct(F.lit(i).alias("shift"), bits.bitwiseAND(F.lit(long_mask(step * (i + 1)))).alias("prefix")) for i in range(-(-64 // step))])


def big_endian(x: Column) -> Column:
    """Eight bytes of a bigint, highest first."""
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def _byte(b: Column, i: int) -> Column:
    """The byte at place i, from 0, as a number; 0 beyond the end."""
    return F.coalesce(F.conv(F.hex(F.substring(b, i + 1, 1)), 16, 10).cast("bigint"), F.lit(0))


def from_big_endian(b: Column) -> Column:
    """The inverse of ``big_endian``; null unless there are eight bytes."""
    return F.when(F.octet_length(b) == 8, F.conv(F.hex(b), 16, -10).cast("bigint"))


def compare_bytes(a: Column, b: Column) -> Column:
    """-1, 0 or 1: the order of byte strings by unsigned bytes; of two that agree as far as both go the shorter is the greater."""
    short = F.least(F.octet_length(a), F.octet_length(b))
    x, y = F.substring(a, F.lit(1), short), F.substring(b, F.lit(1), short)
    return F.when(x < y, -1).when(x > y, 1).otherwise(F.signum(F.octet_length(b) - F.octet_length(a)).cast("int"))


def seven_bit(x: Column) -> Column:
    """Ten bytes: 9 times 7 bits from the highest down, then the lowest bit."""
    parts = [F.shiftright(x, s).bitwiseAND(F.lit(0x7F)) for s in range(57, 0, -7)] + [x.bitwiseAND(F.lit(1))]
    return F.unhex(F.concat(*[F.lpad(F.hex(p), 2, "0") for p in parts]))


def variable_length(x: Column) -> Column:
    """A non-negative number in groups of 7 bits, lowest first, a set high bit meaning that more follow; null below 0."""
    byte = lambda i: F.shiftrightunsigned(x, 7 * i)
    one = lambda i: F.when(byte(i) != 0, F.lpad(F.hex(byte(i).bitwiseAND(F.lit(0x7F)).bitwiseOR(F.when(F.shiftrightunsigned(byte(i), 7) != 0, F.lit(0x80)).otherwise(F.lit(0)))), 2, "0")).otherwise(F.lit(""))
    return F.when(x == 0, F.unhex(F.lit("00"))).when(x > 0, F.unhex(F.concat(*[one(i) for i in range(9)])))


def from_seven_bit(b: Column) -> Column:
    """The inverse of ``seven_bit``; null unless there are ten bytes."""
    out = _byte(b, 9)
    for i, s in enumerate(range(57, 0, -7)):
        out = out.bitwiseOR(F.shiftleft(_byte(b, i), s))
    return F.when(F.octet_length(b) == 10, out)


def shifted_seven_bit(x: Column, shift: int) -> Column:
    """``seven_bit`` after one byte with the shift."""
    return F.concat(F.unhex(F.lit(f"{shift:02X}")), seven_bit(x))


def from_variable_length(b: Column) -> Column:
    """The number that a string of bytes starts with, by the rule of ``variable_length``; null if it is cut off or too long."""
    own = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.coalesce(F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("bigint"), F.lit(0)))

    def step(s: Column, x: Column) -> Column:
        value = s["value"].bitwiseOR(F.call_function("shiftleft", x.bitwiseAND(F.lit(0x7F)), s["length"] * 7))
        more = x.bitwiseAND(F.lit(0x80)) != 0
        return F.when(s["more"], F.struct(value.alias("value"), (s["length"] + 1).alias("length"), more.alias("more"))).otherwise(s)

    start = F.struct(F.lit(0).cast("bigint").alias("value"), F.lit(0).alias("length"), F.lit(True).alias("more"))
    return F.aggregate(own, start, step, lambda s: F.when(~s["more"] & (s["length"] <= F.octet_length(b)), s["value"]))


def date_text(day: Column | None = None) -> Column:
    """A day (today without one) as yyyyMMdd."""
    return F.date_format(F.current_date() if day is None else day, "yyyyMMdd")
