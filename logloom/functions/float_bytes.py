"""Vectors as stored bytes (32-bit floats, little-endian) and back, by arithmetic on exact doubles.

Spark casts no float to its bits, so sign, exponent and fraction are computed: each step is a
multiplication by a power of two or a difference of near values, and loses nothing.

Defined cases: a null vector is null, an empty one gives no bytes; a null component is stored as
NaN; components beyond 32 bits are rounded to the nearest float; signed zeros, infinities and
floats below the least normal one keep their bits. Bytes that are no whole number of floats
read as null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The layout of a 32-bit float.
FRACTION_BITS, BIAS, LEAST, INFINITE, NOT_A_NUMBER, LARGEST = 23, 127, -126, 0x7F800000, 0x7FC00000, 3.4028234663852886e38


def power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def exponent_of(size: Column, guess: Column) -> Column:
    """The exponent of a positive size; logarithms round, so the guess may be one off."""
    exact = guess - F.when(size < power(guess), 1).otherwise(0) + F.when(size >= power(guess + 1), 1).otherwise(0)
    return F.greatest(exact, F.lit(LEAST))


def bits_of(single: Column, size: Column, exponent: Column) -> Column:
    """The 32 bits of a float as a long from 0."""
    # below the least normal float the leading one is not there, which the field of 0 stands for
    finite = (exponent + BIAS - 1) * (1 << FRACTION_BITS) + size / power(exponent) * (1 << FRACTION_BITS)
    bits = F.when(single.isNull() | F.isnan(single), NOT_A_NUMBER).when(size == float("inf"), INFINITE).when(size == 0, 0).otherwise(finite.cast("long"))
    negative = ~F.isnan(single) & ((single < 0) | ((single == 0) & F.startswith(single.cast("string"), F.lit("-"))))
    return bits.cast("long") + F.when(negative, 1 << 31).otherwise(0)


def floats_to_bytes(vector: Column) -> Column:
    """Each step is a pass of its own over the array, so that what it computes is computed once."""
    parts = F.transform(vector, lambda x: F.struct(x.cast("float").alias("x"), F.abs(x.cast("float").cast("double")).alias("size")))
    parts = F.transform(parts, lambda p: F.struct(p["x"].alias("x"), p["size"].alias("size"), F.floor(F.log2(F.least(p["size"], F.lit(LARGEST)))).alias("guess")))
    parts = F.transform(parts, lambda p: F.struct(p["x"].alias("x"), p["size"].alias("size"), exponent_of(p["size"], p["guess"]).alias("exponent")))
    digits = F.transform(F.transform(parts, lambda p: bits_of(p["x"], p["size"], p["exponent"])), lambda bits: F.lpad(F.hex(bits), 8, "0"))
    turned = F.transform(digits, lambda h: F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)]))
    return F.unhex(F.array_join(turned, ""))


def float_of(bits: Column) -> Column:
    field, fraction = F.shiftright(bits, FRACTION_BITS).bitwiseAND(255), bits.bitwiseAND((1 << FRACTION_BITS) - 1)
    whole = F.when(field == 0, fraction).otherwise(fraction + (1 << FRACTION_BITS))
    finite = whole * power(F.greatest(field, F.lit(1)) - BIAS - FRACTION_BITS)
    size = F.when(field < 255, finite).when(fraction == 0, float("inf")).otherwise(float("nan"))
    return (size * F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)).cast("float")


def bytes_to_floats(raw: Column) -> Column:
    """array<float> of stored bytes."""
    digits = F.regexp_extract_all(F.hex(raw), F.lit(".{8}"), F.lit(0))
    turned = F.transform(digits, lambda h: F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)]))
    floats = F.transform(F.transform(turned, lambda h: F.conv(h, 16, 10).cast("long")), float_of)
    return F.when(F.octet_length(raw) % 4 == 0, floats)
