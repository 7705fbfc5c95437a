"""Aggregates: global reductions, groups, distinct values, composite keys, segments, bounded selection."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import fail
from ..plans.order import ranked

AGGREGATES = ("sum", "count", "mean", "min", "max", "var", "std", "nunique")


def aggregate(op: str, column: str, skipna: bool = True, ddof: int = 0) -> Column:
    """One aggregate. Integer sums are exact in 64 bits. ``skipna=False`` gives NaN where a value is NULL or NaN, and counts rows."""
    c = F.col(f"`{column}`")
    if op == "count":
        return F.count(c) if skipna else F.count(F.lit(1))
    if op == "nunique":
        return F.count_distinct(c)
    n = F.count(c)
    made = {"sum": lambda: F.sum(c), "mean": lambda: F.avg(c), "min": lambda: F.min(c), "max": lambda: F.max(c)}
    if op in ("var", "std"):
        pop = F.var_pop(c)
        found = pop if ddof == 0 else F.when(n > ddof, pop * n / F.nullif(n - ddof, F.lit(0)))
        found = F.sqrt(found) if op == "std" else found
    elif op in made:
        found = made[op]()
    else:
        raise fail("aggregate", f"{op!r} is no aggregate.", f"use one of {', '.join(AGGREGATES)}.")
    if skipna:
        return found
    return F.when(F.count_if(c.isNull() | F.isnan(c.cast("double"))) > 0, F.lit(float("nan"))).otherwise(found.cast("double"))


def reduce(df: DataFrame, op: str, column: str, skipna: bool = True, ddof: int = 0):
    """A global aggregate as a Python value."""
    return df.agg(aggregate(op, column, skipna, ddof)).first()[0]


def group(df: DataFrame, keys: str | list[str], aggs: dict[str, tuple[str, ...] | list[str] | str], null_keys: str = "keep", drop_null_measures: bool = False, sep: str = ".") -> DataFrame:
    """Group by one or more keys; output columns are named column, separator, aggregate.

    ``null_keys``: 'keep' them as a group, 'drop' them, or 'refuse' with the count of NULLs (which runs a job).
    ``drop_null_measures`` leaves out rows with a NULL in any measure before grouping.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    aggs = {c: (ops,) if isinstance(ops, str) else tuple(ops) for c, ops in aggs.items()}
    for c in (*keys, *aggs):
        if c not in df.columns:
            raise fail("group", f"no column {c!r}.", f"use one of {', '.join(df.columns)}.")
    if null_keys == "refuse":
        counts = df.agg(*(F.count_if(F.col(f"`{k}`").isNull()).alias(f"k{i}") for i, k in enumerate(keys))).first()
        for k, n in zip(keys, counts):
            if n:
                raise fail("group", f"key {k!r} holds {n} NULLs.", f"filter(c({k!r}).is_null().not_()) first.")
    elif null_keys == "drop":
        df = df.dropna(subset=keys)
    if drop_null_measures:
        df = df.dropna(subset=list(aggs))
    for c, ops in aggs.items():
        if dict(df.dtypes)[c] == "string" and any(op not in ("count", "nunique", "min", "max") for op in ops):
            raise fail("group", f"measure {c!r} is text.", "count it, or take min, max or nunique.")
    return df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*(aggregate(op, c).alias(f"{c}{sep}{op}") for c, ops in aggs.items() for op in ops))


def group_topk(df: DataFrame, keys: list[str], aggs: dict, order_by: str, k: int, descending: bool = True, sep: str = ".") -> DataFrame:
    """The ``k`` groups of the largest (or least) aggregate; ties go to the lesser key."""
    found = group(df, keys, aggs, sep=sep)
    first = F.col(f"`{order_by}`")
    return found.orderBy(first.desc_nulls_last() if descending else first.asc_nulls_last(), *keys).limit(k)


def unique(df: DataFrame, column: str) -> DataFrame:
    """Distinct values without NULL, in order."""
    return df.select(column).dropna().distinct().orderBy(column)


def _codes(values: DataFrame, order: list[Column], name: str = "code") -> DataFrame:
    """Number rows from 0 in order: a range-partitioned sort, then each partition's own number plus those before it."""
    from ..plans.scratch import written

    ordered = written(values.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id()), "codes")
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("c"), F.min("__n").alias("__begin"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("__part").alias("__p"), "__begin", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__before"))
    out = ordered.join(F.broadcast(base), F.col("__part") == F.col("__p"))
    return out.withColumn(name, F.col("__n") - F.col("__begin") + F.col("__before")).drop("__part", "__p", "__n", "__begin", "__before")


def dictionary(df: DataFrame, column: str, order: str = "sorted", order_by: list[str] | None = None) -> DataFrame:
    """value, code: distinct values without NULL, numbered in sorted order or in order of first appearance."""
    if order == "sorted":
        values = df.select(F.col(column).alias("value")).dropna().distinct()
        return _codes(values, [F.col("value")])
    if order != "first_seen" or not order_by:
        raise fail("dictionary", f"order is {order!r}.", "use 'sorted', or 'first_seen' with order_by.")
    seen = ranked(df, order_by).select(F.col(column).alias("value"), "__rn").dropna(subset=["value"]).groupBy("value").agg(F.min("__rn").alias("first"))
    return _codes(seen, [F.col("first")]).select("value", "code")


def unique_inverse(df: DataFrame, column: str, out: str = "inv") -> DataFrame:
    """Each row with the position of its value among the sorted distinct ones; -1 for NULL."""
    codes = dictionary(df, column).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    # NULL keys stay out of the join, where all of them would meet in one task
    found = df.filter(F.col(column).isNotNull()).join(codes, df[column] == F.col("__value"), "left").withColumn(out, F.coalesce("__code", F.lit(-1).cast("long"))).drop("__value", "__code")
    return found.unionByName(df.filter(F.col(column).isNull()).withColumn(out, F.lit(-1).cast("long")))


def pack_keys(*keys: Column, mode: str = "pack", sizes: list[int] | None = None) -> Column:
    """A 64-bit key of integer columns: two 32-bit halves, or mixed radix by ``sizes`` (products beyond 64 bits raise)."""
    if mode == "pack":
        if len(keys) != 2:
            raise fail("pack_keys", f"{len(keys)} keys do not fit two halves.", "use mode='radix' with sizes.")
        return F.shiftleft(keys[0].cast("long"), 32).bitwiseOR(keys[1].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    if mode == "hash":
        return F.xxhash64(*keys)
    if mode != "radix" or not sizes or len(sizes) != len(keys):
        raise fail("pack_keys", "radix needs a size for each key.", "pass sizes=[max + 1 of each key].")
    return fold(lambda acc, ks: acc * F.lit(ks[1]) + ks[0].cast("long"), zip(keys[1:], sizes[1:]), keys[0].cast("long"))


def segmented_reduce(values: DataFrame, bounds: DataFrame, op: str, pos: str = "pos", value: str = "value", segment: str = "segment", begin: str = "begin", end: str = "end") -> DataFrame:
    """segment, result: an aggregate over the positions [begin, end) of each segment.

    Segments do not overlap. Empty ones sum and count to 0 and have no min or max (NULL). Integer sums saturate at 32 bits. Values
    find their segment by a sorted merge of values and segment starts in blocks, not by comparing all with all.
    """
    if op not in ("sum", "count", "min", "max"):
        raise fail("segmented_reduce", f"{op!r} is no aggregate here.", "use sum, count, min or max.")
    kind = dict(values.dtypes)[value]
    # each segment covers whole blocks of positions and two part blocks, so the join is an equality on blocks
    width = 1024
    pieces = bounds.filter(F.col(end) > F.col(begin)).select(segment, begin, end, F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width))).alias("__block"))
    rows = values.select(F.col(pos).alias("__pos"), F.col(value).alias("__value"), F.floor(F.col(pos) / width).alias("__block"))
    inside = rows.join(pieces, "__block").filter((F.col("__pos") >= F.col(begin)) & (F.col("__pos") < F.col(end)))
    found = inside.groupBy(segment).agg(F.count(F.lit(1)).alias("__n"), {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[op]("__value").alias("__x"))
    out = bounds.select(segment).join(found, segment, "left")
    if op == "count":
        return out.select(segment, F.coalesce("__n", F.lit(0).cast("long")).alias("result"))
    if op == "sum":
        total = F.coalesce("__x", F.lit(0))
        return out.select(segment, (F.least(F.greatest(total, F.lit(-(1 << 31))), F.lit((1 << 31) - 1)) if kind in ("int", "bigint", "smallint", "tinyint") else total).alias("result"))
    return out.select(segment, F.col("__x").alias("result"))


def bounded_select(df: DataFrame, group_by: str | list[str], order_by: list[str], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in order, numbered from 0. Catalyst limits each group before the shuffle."""
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k).withColumn(out, (F.col(out) - 1).cast("long"))
