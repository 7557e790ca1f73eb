"""Columns that read values out of a binary column at a byte offset (from 0), all by built-in functions.

Each is null where the bytes are null or end before the value does, and where the offset is negative.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hex_at(data: Column, at: int, width: int, little: bool = False) -> Column:
    """The ``width`` bytes as upper-case hex digits, the highest byte first."""
    whole = F.substring(data, at + 1, width)
    spelt = F.concat(*(F.hex(F.substring(data, at + i + 1, 1)) for i in reversed(range(width)))) if little else F.hex(whole)
    return F.when(F.lit(at >= 0) & (F.octet_length(whole) == width), spelt)


def unsigned(data: Column, at: int, width: int, little: bool = False) -> Column:
    """An unsigned integer of 1 to 7 bytes, as a long."""
    return F.conv(hex_at(data, at, width, little), 16, 10).cast("long")


def signed(data: Column, at: int, width: int, little: bool = False) -> Column:
    """A two's complement integer of 1 to 8 bytes, as a long."""
    if width == 8:
        return F.conv(hex_at(data, at, width, little), 16, -10).cast("long")
    value = unsigned(data, at, width, little)
    return F.when(value >= 1 << (8 * width - 1), value - (1 << 8 * width)).otherwise(value)


def _ieee(bits: Column, exponent_bits: int, fraction_bits: int) -> Column:
    fraction = bits.bitwiseAND(F.lit((1 << fraction_bits) - 1)).cast("double")
    exponent = F.shiftright(bits, fraction_bits).bitwiseAND(F.lit((1 << exponent_bits) - 1))
    negative = F.shiftright(bits, fraction_bits + exponent_bits).bitwiseAND(F.lit(1)) == 1
    least = 2 - (1 << (exponent_bits - 1)) - fraction_bits
    # Both factors and their product are exact.
    finite = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(float(least))))
    finite = finite.otherwise((fraction + float(1 << fraction_bits)) * F.pow(F.lit(2.0), (exponent - 1 + least).cast("double")))
    endless = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    size = F.when(exponent == (1 << exponent_bits) - 1, endless).otherwise(finite)
    return F.when(bits.isNotNull(), F.when(negative, -size).otherwise(size))


def float32(data: Column, at: int, little: bool = False) -> Column:
    """A float of 4 bytes, as a double of the same value."""
    return _ieee(unsigned(data, at, 4, little), 8, 23)


def float64(data: Column, at: int, little: bool = False) -> Column:
    return _ieee(signed(data, at, 8, little), 11, 52)


def bits(data: Column, at: int) -> Column:
    """The eight bits of a byte."""
    return F.lpad(F.bin(unsigned(data, at, 1)), 8, "0")


def ascii_char(data: Column, at: int) -> Column:
    """The character of a byte in quotes if it is printable, else a middle dot."""
    code = unsigned(data, at, 1)
    return F.when(code.between(32, 126), F.concat(F.lit("'"), F.chr(code), F.lit("'"))).when(code.isNotNull(), "·")


def unix_time(data: Column, at: int) -> Column:
    """Four bytes, the lowest first, as unsigned seconds since 1970."""
    return F.timestamp_seconds(unsigned(data, at, 4, True))


def rgba(data: Column, at: int) -> Column:
    """Four bytes as ``#RRGGBBAA``."""
    return F.concat(F.lit("#"), hex_at(data, at, 4))


def guid(data: Column, at: int) -> Column:
    """Sixteen bytes as a GUID, in their order."""
    return F.regexp_replace(F.lower(hex_at(data, at, 16)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
