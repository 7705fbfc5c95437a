"""Dates as whole seconds since 1970 in 32 bits, UTC, and buckets of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import check_int32_range
from .numeric import floor_div_int


def date_encode(c: Column) -> Column:
    """Epoch seconds of a date or a timestamp without time zone; beyond 1901-12-13 to 2038-01-19 raises."""
    return check_int32_range(F.unix_seconds(c.cast("timestamp_ntz").cast("timestamp")), "date_encode")


def date_decode(c: Column) -> Column:
    return F.timestamp_seconds(c).cast("timestamp_ntz")


def bucket(seconds: Column, width: int) -> Column:
    """Whole widths since 1970, rounded down: 86400 for days, 3600 for hours."""
    return floor_div_int(seconds, F.lit(width))
