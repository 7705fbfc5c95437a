"""Elementwise functions. A NULL input gives NULL. Integer results widen rather than wrap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import fail


def floor_div(a: Column, b: Column) -> Column:
    """Quotient rounded down, as in Python; NULL for a zero divisor."""
    return F.floor(F.try_divide(a.cast("double"), b.cast("double")))


def floor_div_int(a: Column, b: Column) -> Column:
    """The same for integers, exact for all of 64 bits."""
    a, b = a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long"))
    q = F.call_function("div", a, b)
    return F.when((a % b != 0) & ((a < 0) != (b < 0)), q - 1).otherwise(q)


def mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign, as in Python; NULL for a zero divisor."""
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def divide(a: Column, b: Column) -> Column:
    """Quotient in double precision; x/0 is an infinity or NaN, as for IEEE floats."""
    a, b = a.cast("double"), b.cast("double")
    # NaN is above all numbers for Spark; -0.0 equals 0.0, only its text tells it apart
    sign = F.when(b.cast("string") == "-0.0", F.lit(-1.0)).otherwise(F.lit(1.0))
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, sign * float("inf")).when(a < 0, sign * float("-inf"))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def divide_int(a: Column, b: Column) -> Column:
    """Quotient of integers rounded half to even; NULL for a zero divisor."""
    return F.rint(F.try_divide(a.cast("double"), b.cast("double"))).cast("long")


def wrap_int32(c: Column) -> Column:
    """A 64-bit value reduced to 32 bits with wrap-around."""
    # reduced before the addition too, which would overflow near the end of 64 bits
    return (F.pmod(F.pmod(c, F.lit(1 << 32)) + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def round_half_even(c: Column, ndigits: int = 0) -> Column:
    """Round in binary, half to even, to 0..15 digits. NaN, infinities and the sign of zero stay; NULL where the scaled value passes 2^53."""
    if not isinstance(ndigits, int) or not 0 <= ndigits <= 15:
        raise fail("map_round", f"ndigits is {ndigits!r}.", "use an int from 0 to 15.")
    x, scale = c.cast("double"), F.lit(10.0**ndigits)
    scaled = x * scale
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(odd, x).when(F.abs(scaled) <= float(1 << 53), F.rint(scaled) / scale)


def round_half_away(x: Column, digits: int = 0) -> Column:
    """A double rounded in binary, half away from zero: the scaled value is rounded, where Spark rounds the shortest decimal.

    NaN, infinities and the sign of zero stay, and values that scaling would make infinite.
    """
    scale = F.lit(10.0 ** abs(digits))
    # a rounding of the magnitude, as Spark's gives 0.0 for small negative values
    whole = F.round(F.abs(x * scale if digits >= 0 else x / scale)) * F.signum(x)
    out = whole / scale if digits >= 0 else whole * scale
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def ne_nan(a: Column, b: Column) -> Column:
    """a != b where NaN differs from itself."""
    return (a != b) | F.isnan(a) | F.isnan(b)


def eq_nan(a: Column, b: Column) -> Column:
    """a == b where NaN differs from itself."""
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def strict_and(a: Column, b: Column) -> Column:
    """NULL if either side is NULL (not Kleene)."""
    return F.when(a.isNotNull() & b.isNotNull(), a & b)


def strict_or(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), a | b)


def where(mask: Column, yes: Column, no: Column) -> Column:
    """CASE: an unknown mask takes the second branch."""
    return F.when(mask, yes).otherwise(no)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
