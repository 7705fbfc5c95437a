"""Text functions: code points, literal predicates, first-match regular expressions, prefixed-number codes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import fail
from ..types import check_int32_range


def text_length(c: Column, null_as_zero: bool = False) -> Column:
    """Code points; NULL stays NULL unless it is to count as 0."""
    n = F.char_length(c)
    return F.coalesce(n, F.lit(0)) if null_as_zero else n


def regex_replace_first(df: DataFrame, column: str, pattern: str, replacement: str, out: str | None = None) -> DataFrame:
    """Replace the first match only, with Python's regular expressions; NULL stays NULL; a bad pattern raises at once.

    The expression runs once on each distinct value, and the results are joined back, so a value that many rows share costs one
    evaluation. The join is Catalyst's to plan: the distinct values may be as many as the rows.
    """
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        raise fail("regex_replace", f"{pattern!r} is no regular expression ({e}).", "correct the pattern.") from e

    def replaced(batches):
        for batch in batches:
            values = batch.column(0)
            new = [compiled.sub(replacement, v, count=1) for v in values.to_pylist()]
            yield pa.RecordBatch.from_arrays([values, pa.array(new, pa.string())], names=["__value", "__new"])

    values = df.select(F.col(column).alias("__value")).filter("__value is not null").distinct()
    new = values.mapInArrow(replaced, "__value string, __new string")
    out = out or column
    joined = df.join(new, df[column] == new["__value"], "left")
    return joined.select(*(df[c] for c in df.columns if c != out), F.col("__new").alias(out))


def encode_pattern(c: Column, prefix: str) -> Column:
    """``prefix`` and an integer, as that integer; other text NULL; an integer beyond 32 bits raises."""
    number = F.substring(c, len(prefix) + 1, 1 << 20)
    fits = c.startswith(prefix) & number.rlike("^-?[0-9]+$")
    return F.when(fits, check_int32_range(F.when(fits, number).cast("decimal(38,0)"), "encode_pattern"))


def decode_pattern(c: Column, prefix: str, width: int = 0) -> Column:
    """The inverse: zero-padded to ``width`` digits, negative numbers unpadded."""
    digits = c.cast("string")
    padded = F.when((c >= 0) & (F.char_length(digits) < width), F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat(F.lit(prefix), padded)
