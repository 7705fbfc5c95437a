"""Dictionary columns: codes for distinct values, and predicates on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import dictionary, unique_inverse

__all__ = ["dictionary", "encode", "decode", "metadata", "lookup_code", "ordering", "min_max", "range_codes", "member_mask", "count_allowed", "contains", "not_contains", "equal", "not_equal", "not_empty", "all_of"]


def encode(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Each row with its value's code: the rank among the sorted distinct values, NULL for NULL."""
    coded = unique_inverse(df, column, out)
    return coded.withColumn(out, F.when(F.col(out) >= 0, F.col(out)))


def decode(df: DataFrame, codes: DataFrame, column: str, out: str = "value") -> DataFrame:
    """Each row with the value of its code; an unknown code raises at run time, NULL stays NULL."""
    side = codes.select(F.col("code").alias("__code"), F.col("value").alias("__value"), F.lit(True).alias("__hit"))
    rows = df.join(side, df[column] == F.col("__code"), "left")
    unknown = F.raise_error(F.concat(F.lit("dictionary_decode: no code "), F.col(column).cast("string"), F.lit(". Fix: decode with the dictionary that encoded it.")))
    return rows.withColumn(out, F.when(F.col("__hit") | F.col(column).isNull(), F.col("__value")).otherwise(unknown)).drop("__code", "__value", "__hit")


def metadata(codes: DataFrame) -> DataFrame:
    """n, min, max, and whether codes follow the values' order without gaps."""
    return codes.agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), (F.max("code") - F.min("code") + 1 == F.count_distinct("code")).alias("dense"))


def lookup_code(codes: DataFrame, key) -> int | None:
    found = codes.filter(F.col("value") == F.lit(key)).select("code").first()
    return found.code if found else None


def ordering(codes: DataFrame) -> DataFrame:
    """The dictionary with each value's rank in sorted order, whatever order its codes are in."""
    ranks = dictionary(codes, "value").withColumnRenamed("code", "rank")
    return codes.join(ranks, "value")


def length_lut(codes: DataFrame) -> DataFrame:
    """The length of each code's value in characters: code, len."""
    return codes.select("code", F.char_length("value").alias("len"))


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"))


def range_codes(codes: DataFrame, low, high) -> DataFrame:
    """Codes of values from low to high, both included."""
    return codes.filter(F.col("value").between(low, high)).select("code")


def member_mask(c: Column, allowed: list) -> Column:
    """Whether the value is in the list; False for NULL."""
    return F.coalesce(c.isin(list(allowed)), F.lit(False))


def count_allowed(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isin(list(allowed))).alias("n"))


def contains(c: Column, part: str) -> Column:
    """False for NULL, as the three below."""
    return F.coalesce(c.contains(F.lit(part)), F.lit(False))


def not_contains(c: Column, part: str) -> Column:
    return F.coalesce(~c.contains(F.lit(part)), F.lit(False))


def equal(c: Column, value: str) -> Column:
    return F.coalesce(c == F.lit(value), F.lit(False))


def not_equal(c: Column, value: str) -> Column:
    return F.coalesce(c != F.lit(value), F.lit(False))


def not_empty(c: Column) -> Column:
    return not_equal(c, "")


def all_of(*masks: Column) -> Column:
    """Rows that all predicates hold for."""
    return reduce(lambda a, b: a & b, masks)
