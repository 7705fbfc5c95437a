"""Operators defined on row order: shift, running sums, trailing windows, returns. The order is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import fail
from ..functions.numeric import divide, wrap_int32
from ..plans.order import ranked, running, with_window
from ..types import is_integer


def _order(order_by: str | list[str]) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def shift(df: DataFrame, column: str, n: int, out: str, order_by: str | list[str], partition_by: list[str] | None = None) -> DataFrame:
    """The value ``n`` rows before; NULL for the first ``n`` rows; n = 0 is the column itself."""
    if n < 0:
        raise fail("shift", f"n is {n}.", "use 0 or more.")
    return with_window(df, _order(order_by), n + 1, lambda w: {out: F.lag(F.col(column), n).over(w) if n else F.col(column)}, partition_by)


def cumsum(df: DataFrame, column: str, out: str, order_by: str | list[str], partition_by: list[str] | None = None, wrap: bool = False) -> DataFrame:
    """Inclusive running sum. NULL adds 0 and stays NULL; with ``wrap`` the result is reduced to 32 bits.

    Integers are then reduced before they are added too, so that 64 bits hold the sums of 2^32 rows of any size.
    """
    addend = wrap_int32(F.col(column)).cast("long") if wrap and is_integer(df.schema[column].dataType) else F.col(column)
    rows = running(df, {"__sum": F.coalesce(addend, F.lit(0))}, _order(order_by), partition_by)
    total = wrap_int32(F.col("__sum")) if wrap else F.col("__sum")
    return rows.withColumn(out, F.when(F.col(column).isNotNull(), total)).drop("__sum")


def exclusive_sum(df: DataFrame, column: str, out: str, order_by: str | list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Sum of all rows before; 0 for the first."""
    return running(df, {out: F.coalesce(F.col(column), F.lit(0))}, _order(order_by), partition_by, inclusive=False)


def trailing_sum(c: Column, w: Window, width: int, min_periods: int | None = None) -> Column:
    """Sum over the last ``width`` rows: NaN where one of them is NULL or NaN, or where fewer than ``min_periods`` rows are there."""
    frame = w.rowsBetween(-(width - 1), Window.currentRow)
    x = c.cast("double")
    valid = F.when(~F.isnan(x), x)
    rows = F.count(F.lit(1)).over(frame)
    whole = (rows >= (width if min_periods is None else min_periods)) & (F.count(valid).over(frame) == rows)
    return F.when(whole, F.sum(valid).over(frame)).otherwise(F.lit(float("nan")))


def rolling_sum(df: DataFrame, column: str, width: int, out: str, order_by: str | list[str], min_periods: int | None = None, partition_by: list[str] | None = None) -> DataFrame:
    if width < 1:
        raise fail("rolling_sum", f"the window is {width}.", "use 1 or more.")
    return with_window(df, _order(order_by), width, lambda w: {out: trailing_sum(F.col(column), w, width, min_periods)}, partition_by)


def rolling_mean(df: DataFrame, column: str, width: int, out: str, order_by: str | list[str], min_periods: int | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """The rolling sum over the full width, also where fewer rows are there."""
    if width < 1:
        raise fail("rolling_mean", f"the window is {width}.", "use 1 or more.")
    return with_window(df, _order(order_by), width, lambda w: {out: trailing_sum(F.col(column), w, width, min_periods) / width}, partition_by)


def returns(df: DataFrame, column: str, out: str, order_by: str | list[str], partition_by: list[str] | None = None) -> DataFrame:
    """x / previous x - 1; NULL in the first row."""
    return with_window(df, _order(order_by), 2, lambda w: {out: divide(F.col(column), F.lag(F.col(column).cast("double")).over(w)) - 1}, partition_by)


def gather(values: DataFrame, index: DataFrame, order_by: str | list[str], column: str, idx: str, out: str) -> DataFrame:
    """The value at each position of ``index``; a position that is not there raises at run time."""
    at = ranked(values, _order(order_by), "__pos").select("__pos", F.col(column).alias("__value"), F.lit(True).alias("__there"))
    rows = index.join(at, F.col(idx).cast("long") == F.col("__pos"), "left")
    value = F.when(F.col("__there"), F.col("__value")).otherwise(F.raise_error(F.concat(F.lit("gather: no row "), F.col(idx).cast("string"), F.lit(". Fix: use positions from 0 to the row count less 1."))))
    return rows.withColumn(out, value).drop("__pos", "__value", "__there")
