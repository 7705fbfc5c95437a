"""Positions without a single-task window: rank by buckets of the order key, then windows over blocks with a margin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import fail
from .scratch import bounded, written

#: Rows for a bucket or block, and the most buckets: their sums are one small table.
BLOCK = 250_000
MOST_BUCKETS = 4096


def _number(df: DataFrame, key: str) -> Column:
    """A double that rises, not strictly, with an order key of any number, time, boolean, text or binary type; NULL where it is."""
    kind, col = dict(df.dtypes)[key], F.col(key)
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(col.cast("timestamp")).cast("double")
    if kind == "string" or kind == "binary":
        # the first six bytes as a number; texts that have them in common share a bucket
        head = F.rpad(F.hex(F.substring(col.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if kind == "boolean":
        return col.cast("int").cast("double")
    if not re.match(r"tinyint|smallint|int|bigint|float|double|decimal", kind):
        raise fail("order", f"{key!r} is of type {kind}.", "order by a number, time or text column.")
    return col.cast("double")


def _search(number: Column, bounds: list[float]) -> Column:
    """How many of the rising bounds lie below a number."""

    def tree(part: list[float], low: int) -> Column:
        """Comparisons in the logarithm of the bounds' number, within generated code."""
        if not part:
            return F.lit(low)
        mid = len(part) // 2
        return F.when(number <= part[mid], tree(part[:mid], low)).otherwise(tree(part[mid + 1 :], low + mid + 1))

    return tree(bounds, 0) if len(bounds) <= 256 else F.size(F.filter(F.lit(bounds), lambda b: b < number))


def _bucketed(df: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Add ``__bucket``, which does not fall in the order of ``keys``: NULL first, NaN last, as Spark sorts.

    Buckets are bounded by quantiles of the first key. A value that several quantiles fall on, a hot tie, is split by quantiles of
    the second key. Two or three aggregations run for this.
    """
    rows = df.count()
    n = min(MOST_BUCKETS, -(-rows // block))
    if n <= 1:
        return df.withColumn("__bucket", F.lit(0).cast("long"))
    first = _number(df, keys[0])
    whole = F.when(~F.isnan(first), first)
    found = df.select(F.percentile_approx(whole, [i / n for i in range(1, n)], 10 * n).alias("q")).first().q or []
    bounds = sorted(set(found))
    step = n + 1
    bucket = F.when(first.isNull(), F.lit(0)).otherwise(_search(first, bounds) + 1).cast("long") * step
    hot = [b for b in bounds if found.count(b) > 1]
    if len(keys) > 1 and hot:
        second = _number(df, keys[1])
        inner = df.filter(first.isin(hot)).groupBy(first.alias("k")).agg(F.percentile_approx(F.when(~F.isnan(second), second), [i / n for i in range(1, n)], 10 * n).alias("q"), F.min(keys[0]).alias("lo"), F.max(keys[0]).alias("hi")).collect()
        sub = F.lit(0)
        for r in inner:
            if r.lo != r.hi:  # keys that only look alike as numbers: long texts, very large integers
                continue
            share = sorted(set((r.q or [])[:: max(1, n // (found.count(r.k) + 1))]))
            sub = F.when(first == r.k, F.when(second.isNull(), F.lit(0)).otherwise(_search(second, share) + 1)).otherwise(sub)
        # other values of the bucket lie below the tie, which is its upper bound
        bucket = bucket + sub
    return df.withColumn("__bucket", bucket)


def running(df: DataFrame, values: dict[str, Column], order_by: list[str], partition_by: list[str] | None = None, inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Running sums of ``values`` (output name to addend) in order; exclusive ones leave the own row out.

    Sums within buckets of the order key are windows over one bucket each; the buckets' totals, one row for each, are summed up
    and added. With ``partition_by`` the groups are the buckets.
    """
    addends = {f"__v{i}": v for i, v in enumerate(values.values())}
    rows = df.withColumns(addends)
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    if partition_by:
        w = frame(Window.partitionBy(*partition_by).orderBy(*order_by))
        out = rows.withColumns({name: F.coalesce(F.sum(v).over(w), F.lit(0)) for name, v in zip(values, addends)})
        return out.drop(*addends)
    rows = _bucketed(rows, order_by, block)
    totals = rows.groupBy("__bucket").agg(*(F.sum(v).alias(f"{v}t") for v in addends))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("__bucket").alias("__b"), *(F.coalesce(F.sum(f"{v}t").over(before), F.lit(0)).alias(f"{v}b") for v in addends))
    w = frame(Window.partitionBy("__bucket").orderBy(*order_by))
    out = rows.withColumns({f"{v}w": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in addends}).join(F.broadcast(base), F.col("__bucket") == F.col("__b"))
    out = out.withColumns({name: F.col(f"{v}w") + F.col(f"{v}b") for name, v in zip(values, addends)})
    return out.drop("__bucket", "__b", *addends, *(f"{v}{x}" for v in addends for x in "wb"))


def numbered(df: DataFrame, order: tuple[Column, ...] | list[Column], name: str) -> DataFrame:
    """Each row's position from 0 in any order of columns, with flags of its own for each.

    The rows are range-partitioned and sorted by Spark and written; a row's place within its partition is added to the row counts
    of the partitions before, a row for each.
    """
    rows = written(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33)
    counts = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    base = bounded(counts.select("__p", F.coalesce(before, F.lit(0)).alias("__b")), "partitions")
    out = rows.join(base, part == F.col("__p"))
    return out.withColumn(name, F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__b")


def ranked(df: DataFrame, order_by: list[str], name: str = "__rn") -> DataFrame:
    """Each row's position from 0 in the whole order."""
    return running(df, {name: F.lit(1).cast("long")}, order_by, inclusive=False)


def with_window(df: DataFrame, order_by: list[str], width: int, columns: Callable[[Window], dict[str, Column]], partition_by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Add columns that look back at most ``width`` - 1 rows.

    Rows are dealt into blocks by position; each block also gets the last ``width`` - 1 rows of the one before, which are dropped
    again. ``columns`` gets the window specification, without a frame.
    """
    if partition_by:
        return df.withColumns(columns(Window.partitionBy(*partition_by).orderBy(*order_by)))
    block = max(block, 4 * width)
    rows = ranked(df, order_by)
    at = F.floor(F.col("__rn") / block)
    own = F.struct(at.alias("b"), F.lit(True).alias("own"))
    margin = F.when(F.col("__rn") % block >= block - (width - 1), F.array(own, F.struct((at + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(own))
    dealt = rows.withColumn("__at", F.explode(margin)).withColumns({"__b": F.col("__at.b"), "__own": F.col("__at.own")}).drop("__at")
    out = dealt.withColumns(columns(Window.partitionBy("__b").orderBy("__rn")))
    return out.filter("__own").drop("__b", "__own", "__rn")
