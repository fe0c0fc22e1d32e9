"""Encoders of strings, dates and addresses to whole numbers, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import functions as F


def _codes(text):
    """Code points of the characters."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))


def string_code(text):
    """Sum of (place from 1) x (code point); '' is 0.  Different strings can share a code."""
    places = F.transform(_codes(text), lambda c, i: c * (i + 1))
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x))


def name_code(text):
    """Sum of byte x 31^place in 64-bit arithmetic that wraps, then modulo 2^32 - 1."""
    wrap, decimal = F.lit("18446744073709551616").cast("decimal(38,0)"), "decimal(38,0)"
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda i: F.conv(F.hex(F.substring(F.encode(text, "utf-8"), i, F.lit(1))), 16, 10).cast(decimal))
    start = F.struct(F.lit(0).cast(decimal).alias("sum"), F.lit(1).cast(decimal).alias("by"))
    step = lambda a, x: F.struct(((a["sum"] + (a["by"] * x) % wrap) % wrap).cast(decimal).alias("sum"), ((a["by"] * 31) % wrap).cast(decimal).alias("by"))
    total = F.aggregate(octets, start, step, lambda a: (a["sum"] % F.lit(4294967295).cast(decimal)).cast("long"))
    return F.when(text == "", F.lit(0).cast("long")).otherwise(total)


def date_code(text):
    """'y-m-d' as y * 365 + m * 30 + d; a part that is no whole number counts as 0, and so does anything without three parts.
    Some dates share a code."""
    parts = F.split(text, "-")
    number = lambda i: F.coalesce(F.when(F.try_element_at(parts, F.lit(i)).rlike(r"^\+?\d{1,9}$"), F.try_element_at(parts, F.lit(i)).try_cast("long")), F.lit(0).cast("long"))
    return F.when(F.size(parts) == 3, number(1) * 365 + number(2) * 30 + number(3)).otherwise(F.lit(0).cast("long"))


def stamp_code(text):
    """``date_code`` of what stands before the first T."""
    return date_code(F.substring_index(text, "T", 1))


def ipv4_code(text):
    """A dotted quad as an unsigned 32-bit number; null if it is none."""
    parts = F.split(text, r"\.")
    whole = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^(0|[1-9]\d{0,2})$"))
    octet = [F.try_element_at(parts, F.lit(i)).try_cast("long") for i in (1, 2, 3, 4)]
    inside = (octet[0] <= 255) & (octet[1] <= 255) & (octet[2] <= 255) & (octet[3] <= 255)
    return F.when(whole & inside, octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3])


def gender_code(text):
    return F.when(text == "male", 1).otherwise(0)


def organisation_code(text):
    return F.when(text == "company", 1).otherwise(0)
