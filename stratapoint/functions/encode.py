"""Record codecs as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I32 = (-(2**31), 2**31 - 1)
ANGLE = 0.006  # fixed value: degrees a step of the stored scan angle


def quantize(v: Column, scale: float, offset: float) -> Column:
    """Nearest step, halves away from zero; null where it isn't finite or doesn't fit 32 bits."""
    steps = F.round((v - F.lit(float(offset))) / F.lit(float(scale)))
    return F.when((steps >= I32[0]) & (steps <= I32[1]), steps).cast("int")


def dequantize(i: Column, scale: float, offset: float) -> Column:
    return i * F.lit(float(scale)) + F.lit(float(offset))


def angle_steps(degrees: Column) -> Column:
    """Stored scan angle, in single precision; null where it doesn't fit 16 bits."""
    steps = F.round((degrees.cast("double") / F.lit(ANGLE).cast("float").cast("double")).cast("float"))
    return F.when((steps >= -32768) & (steps <= 32767), steps).cast("short")


def angle_degrees(steps: Column) -> Column:
    return steps.cast("float") * F.lit(ANGLE).cast("float")


def pack_returns(number: Column, of: Column) -> Column:
    return number.cast("int").bitwiseAND(F.lit(15)).bitwiseOR(F.shiftleft(of.cast("int").bitwiseAND(F.lit(15)), 4))


def pack_flags(synthetic: Column, key_point: Column, withheld: Column, overlap: Column, channel: Column, direction: Column, edge: Column) -> Column:
    out = channel.cast("int").bitwiseAND(F.lit(3)) * 16
    for bit, c in ((0, synthetic), (1, key_point), (2, withheld), (3, overlap), (6, direction), (7, edge)):
        out = out + c.cast("int") * (1 << bit)
    return out


def unpack_returns(byte: Column) -> dict[str, Column]:
    return {"return_number": byte.bitwiseAND(F.lit(15)), "number_of_returns": F.shiftright(byte, 4).bitwiseAND(F.lit(15))}


def unpack_flags(byte: Column) -> dict[str, Column]:
    bit = lambda n: F.shiftright(byte, n).bitwiseAND(F.lit(1)) == 1
    return {"synthetic": bit(0), "key_point": bit(1), "withheld": bit(2), "overlap": bit(3), "scan_channel": F.shiftright(byte, 4).bitwiseAND(F.lit(3)), "scan_direction_flag": bit(6), "edge_of_flight_line": bit(7)}


def class_read(c: Column) -> Column:
    """Legacy overlap class 12 is reported as 1; the overlap flag is a bit of its own."""
    return F.when(c == 12, F.lit(1)).otherwise(c)


def civil_day(days: Column) -> tuple[Column, Column]:
    """Year and day of the year (from 1) of a count of days since 1970-01-01."""
    d = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    return F.year(d), F.dayofyear(d)
