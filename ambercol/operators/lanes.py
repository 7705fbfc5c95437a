"""Row-wise operators over lanes, bit masks, last-write-wins tables, travel costs and row interning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import fail
from .grouping import _codes

#: The value that stands for no path and no speed.
INF = 4294967295
#: Most lanes of a row, and probes of a sweep: both become columns of one plan.
MOST_LANES = 256


def argmin(lanes: Column) -> Column:
    """Position of the least element of an array, from 0; the first of several."""
    return (F.array_position(lanes, F.array_min(lanes)) - 1).cast("int")


def rowwise_argmin_gather(df: DataFrame, times: list[str] | str, payload: list[str] | str, out: tuple[str, str, str] = ("t", "lane", "d")) -> DataFrame:
    """Least of each row's lanes, its lane, and that lane's payload. Lanes are columns, or one array column."""
    t, d = (F.col(x) if isinstance(x, str) else F.array(*x) for x in (times, payload))
    if not isinstance(times, str) and not 1 <= len(times) <= MOST_LANES:
        raise fail("rowwise_argmin", f"{len(times)} lanes.", f"use 1 to {MOST_LANES}.")
    return df.withColumns({out[0]: F.array_min(t), out[1]: argmin(t), out[2]: F.get(d, argmin(t))})


def bitmask_sweep(df: DataFrame, mask: str, probes: list[int]) -> DataFrame:
    """Each row with ``hits`` (an array: whether the mask holds all bits of each probe) and ``popcnt``."""
    if not 1 <= len(probes) <= MOST_LANES:
        raise fail("bitmask_sweep", f"{len(probes)} probes.", f"use 1 to {MOST_LANES}.")
    m = F.col(mask)
    return df.withColumns({"hits": F.array(*(m.bitwiseAND(F.lit(p)) == F.lit(p) for p in probes)), "popcnt": F.bit_count(m).cast("int")})


def bitmask_counts(df: DataFrame, mask: str, probes: list[int]) -> DataFrame:
    """probe, count: rows whose mask holds all bits of each probe. One pass; a row for each probe."""
    m = F.col(mask)
    one = df.agg(*(F.count_if(m.bitwiseAND(F.lit(p)) == F.lit(p)).alias(f"p{i}") for i, p in enumerate(probes)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(p).cast("long").alias("probe"), F.col(f"p{i}").alias("count")) for i, p in enumerate(probes)))).alias("r")).select("r.probe", "r.count")


def pair_insert(df: DataFrame, key: str, value: str, order_by: str) -> DataFrame:
    """key, value: the last value written for each key."""
    return df.groupBy(F.col(key).alias("key")).agg(F.max_by(value, order_by).alias("value"))


def cost_travel(dist: Column, speed: Column, k: int) -> Column:
    """dist * k / speed rounded half up, 1 at least for a positive distance; INF without a path or a speed."""
    if k == 0:
        raise fail("cost_travel", "k is 0.", "use a positive factor.")
    d, s = dist.cast("long"), speed.cast("long")
    none = (d == INF) | (s == INF) | (s == 0)
    half_up = F.call_function("div", d * k + F.call_function("div", s, F.lit(2)), F.nullif(s, F.lit(0).cast("long")))
    return F.when(none, F.lit(INF)).otherwise(F.greatest(half_up, F.when(d > 0, 1).otherwise(0))).cast("long")


def cost_travel_floor(dist: Column, speed: Column, k: int) -> Column:
    """The same, rounded down."""
    d, s = dist.cast("long"), speed.cast("long")
    none = (d == INF) | (s == INF) | (s == 0)
    return F.when(none, F.lit(INF)).otherwise(F.greatest(F.call_function("div", d * k, F.nullif(s, F.lit(0).cast("long"))), F.when(d > 0, 1).otherwise(0))).cast("long")


def intern_rows(df: DataFrame, columns: list[str], order_by: str, out: str = "id") -> DataFrame:
    """Each row with the number of its value combination, in order of first appearance."""
    seen = df.groupBy(*columns).agg(F.min(order_by).alias("__first"))
    ids = _codes(seen, [F.col("__first")], out).select(out, *(F.col(c).alias(f"__{c}") for c in columns))
    same = reduce(lambda a, b: a & b, (df[c].eqNullSafe(ids[f"__{c}"]) for c in columns))
    return df.join(ids, same).drop(*(f"__{c}" for c in columns))


def hour_bucket(seconds: Column) -> Column:
    """Hour of the day of epoch seconds, UTC."""
    return F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int")
