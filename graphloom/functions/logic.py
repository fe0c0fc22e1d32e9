"""Small scalar building blocks over Columns: 0/1 logic, selection, range checks, sums and byte composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F


def all_of(*flags):
    return reduce(lambda a, b: a & b, flags)


def any_of(*flags):
    return reduce(lambda a, b: a | b, flags)


def negate(flag):
    return ~flag


def differ(a, b):
    """Exclusive or of two booleans."""
    return a != b


def choose(flag, when_true, when_false):
    return F.when(flag, when_true).otherwise(when_false)


def is_zero(value):
    return value == 0


def is_bit(value):
    return value.isin(0, 1)


def in_range(value, size: int):
    """0 <= value < size."""
    return value.between(0, size - 1)


def within(index, begin, end):
    """begin <= index < end, as in a slice."""
    return (index >= begin) & (index < end)


def total(*values):
    return reduce(lambda a, b: a + b, values)


def little_endian(octets):
    """An array of bytes, least first, as a number (at most seven bytes, to stay within a long; ``limbs`` and
    ``wide_little_endian`` take sixteen)."""
    return F.aggregate(F.reverse(octets), F.lit(0).cast("long"), lambda a, x: a * 256 + x)


def limbs(octets):
    """Up to sixteen bytes, least first, as two whole numbers below 2^64: ``high`` and ``low``.  Null if there are more bytes,
    or if any is null or no byte."""
    wide = lambda part: F.aggregate(F.reverse(part), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a * F.lit(256).cast("decimal(3,0)") + x.cast("decimal(3,0)")).cast("decimal(38,0)"))
    fits = (F.size(octets) <= 16) & F.coalesce(F.forall(octets, lambda x: x.isNotNull() & x.between(0, 255)), F.lit(False))
    found = F.struct(*[wide(F.slice(octets, begin, 8)).cast("decimal(20,0)").alias(name) for name, begin in (("high", 9), ("low", 1))])
    return F.when(fits, found)


def wide_little_endian(octets):
    """Up to sixteen bytes, least first, as one decimal of 38 digits; null from 10^38 on, and where ``limbs`` is null."""
    pair = limbs(octets)
    # 10^38 = 5421010862427522170 * 2^64 + 687399551400673280
    most, rest, by = (F.lit(x).cast("decimal(20,0)") for x in ("5421010862427522170", "687399551400673280", "18446744073709551616"))
    below = (pair["high"] < most) | ((pair["high"] == most) & (pair["low"] < rest))
    return F.when(below, F.call_function("try_add", F.call_function("try_multiply", pair["high"], by).cast("decimal(38,0)"), pair["low"]).cast("decimal(38,0)"))


def power_of_two(exponent):
    return F.call_function("shiftleft", F.lit(1).cast("long"), exponent.cast("int"))


def lift(value):
    """A Python or Column value as a Column."""
    return value if hasattr(value, "_jc") or hasattr(value, "isNull") else F.lit(value)
