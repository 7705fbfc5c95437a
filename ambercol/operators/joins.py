"""Equality joins against a side of unique keys, lookups and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import fail
from ..plans.order import ranked
from .grouping import dictionary


def check_unique(build: DataFrame, key: str, op: str = "join") -> DataFrame:
    """The build side, after one aggregation has shown that its non-NULL keys are unique."""
    twice = build.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise fail(op, f"build key {key!r} holds {twice[0][0]!r} {twice[0][1]} times.", "group the build side first.")
    return build


def join_inner(probe: DataFrame, build: DataFrame, key: str, build_key: str | None = None, payload: list[str] | None = None, checked: bool = True) -> DataFrame:
    """Probe rows with a match, and the build side's payload. Catalyst broadcasts a build side below its threshold."""
    return _joined(probe, build, key, build_key, payload, checked, "inner")


def join_left(probe: DataFrame, build: DataFrame, key: str, build_key: str | None = None, payload: list[str] | None = None, valid: str = "valid", checked: bool = True) -> DataFrame:
    """All probe rows; payload NULL and ``valid`` False where nothing matches. NULL matches nothing."""
    build = build.withColumn("__hit", F.lit(True))
    out = _joined(probe, build, key, build_key, [*(payload or [c for c in build.columns if c not in ("__hit", build_key or key)]), "__hit"], checked, "left")
    return out.withColumn(valid, F.coalesce("__hit", F.lit(False))).drop("__hit")


def _joined(probe, build, key, build_key, payload, checked, how) -> DataFrame:
    build_key = build_key or key
    if checked:
        check_unique(build, build_key)
    payload = payload or [c for c in build.columns if c != build_key]
    side = build.select(F.col(build_key).alias("__key"), *payload)
    return probe.join(side, probe[key] == F.col("__key"), how).drop("__key")


def semi_join(probe: DataFrame, build: DataFrame, key: str, build_key: str | None = None) -> DataFrame:
    """Probe rows whose key is in the build side, however often."""
    return probe.join(build.select(F.col(build_key or key).alias("__key")), probe[key] == F.col("__key"), "left_semi")


def anti_join(probe: DataFrame, build: DataFrame, key: str, build_key: str | None = None) -> DataFrame:
    return probe.join(build.select(F.col(build_key or key).alias("__key")), probe[key] == F.col("__key"), "left_anti")


def is_member(probe: DataFrame, build: DataFrame, key: str, out: str, build_key: str | None = None) -> DataFrame:
    """A mask column: whether the key is in the build side; False for NULL."""
    side = build.select(F.col(build_key or key).alias("__key")).dropna().distinct().withColumn("__hit", F.lit(True))
    return probe.join(side, probe[key] == F.col("__key"), "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def lookup(probe: DataFrame, build: DataFrame, key: str, build_key: str | None = None, out: str = "pos", hit: str = "hit") -> DataFrame:
    """The position of each key in the sorted unique build keys, -1 on a miss, and a hit mask."""
    build_key = build_key or key
    check_unique(build, build_key, "lookup")
    codes = dictionary(build, build_key).select(F.col("value").alias("__key"), F.col("code").alias("__code"))
    rows = probe.join(codes, probe[key] == F.col("__key"), "left")
    return rows.withColumns({out: F.coalesce("__code", F.lit(-1).cast("long")), hit: F.col("__code").isNotNull()}).drop("__key", "__code")


def lookup_input(probe: DataFrame, build: DataFrame, key: str, order_by: str | list[str], build_key: str | None = None, out: str = "pos", hit: str = "hit") -> DataFrame:
    """The place of each key among the build side's rows as they are ordered, -1 on a miss or for NULL, and a hit mask."""
    build_key = build_key or key
    check_unique(build, build_key, "lookup_input")
    places = ranked(build, [order_by] if isinstance(order_by, str) else list(order_by), "__place").filter(F.col(build_key).isNotNull())
    rows = probe.join(places.select(F.col(build_key).alias("__key"), "__place"), probe[key] == F.col("__key"), "left")
    return rows.withColumns({out: F.coalesce("__place", F.lit(-1).cast("long")), hit: F.col("__place").isNotNull()}).drop("__key", "__place")


def checksum(joined: DataFrame, a: str, b: str, valid: str | None = None) -> DataFrame:
    """Sums of two payloads over valid rows."""
    rows = joined.filter(F.col(valid)) if valid else joined
    return rows.agg(F.coalesce(F.sum(a), F.lit(0)).alias("chk1"), F.coalesce(F.sum(b), F.lit(0)).alias("chk2"))
