"""Arithmetic on vectors: quantising, rotations, low bands, colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The magnitudes that a four-bit e2m1 code can say.
E2M1 = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)


def absmax(v: Column | str) -> Column:
    return F.array_max(F.transform(v, F.abs))


def int8_codes(v: str, scale: str) -> Column:
    """Codes from -127 to 127 by a scale of absmax / 127, half to even."""
    return F.transform(v, lambda x: F.when(F.col(scale) == 0, 0.0).otherwise(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x / F.col(scale))))).cast("int"))


def e2m1(x: Column) -> Column:
    """The nearest magnitude with the sign of x; of two as near, the smaller."""
    m = F.abs(x)
    best = F.lit(E2M1[-1])
    for low, high in reversed(list(zip(E2M1, E2M1[1:], strict=False))):
        best = F.when(m <= (low + high) / 2, F.lit(low)).otherwise(best)
    return F.signum(x) * best


def e4m3(x: Column) -> Column:
    """The nearest number that an eight-bit e4m3 code can say, ties to even, at most 448: three bits behind the leading
    one, and steps of 2 ** -9 below 2 ** -6."""
    power = F.greatest(F.floor(F.log2(F.greatest(F.abs(x), F.lit(2.0**-20)))), F.lit(-6).cast("long"))
    step = F.pow(F.lit(2.0), power - 3)
    return F.least(F.greatest(F.rint(x / step) * step, F.lit(-448.0)), F.lit(448.0))


def low_band(v: str, d: int, n: int) -> Column:
    """One à-trous stage: 1-2-1 weights at distance d, edges repeated."""
    at = lambda i: F.get(F.col(v), F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (at(i - d) + 2 * at(i) + at(i + d)) / 4)


def luma(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.709 luma and colour differences of unit-range samples."""
    y = 0.2126 * r + 0.7152 * g + 0.0722 * b
    return y, (b - y) / 1.8556, (r - y) / 1.5748


def code16(x: Column) -> Column:
    """A unit-range sample as a 16-bit code, half to even."""
    return F.rint(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 65535).cast("long")
