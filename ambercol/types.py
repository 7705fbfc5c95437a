"""Column types, range checks and column schema records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import fail

INT32 = (-(1 << 31), (1 << 31) - 1)
#: Name to (Spark type, accumulator). Narrow integers of 1, 2, 4 and 8 bits are bytes or shorts with a range check.
DTYPES = {
    "int32": (T.IntegerType(), "int64"), "int64": (T.LongType(), "int64"), "float32": (T.FloatType(), "float64"), "float64": (T.DoubleType(), "float64"),
    "bool": (T.BooleanType(), "int64"), "text": (T.StringType(), None), "date": (T.TimestampNTZType(), None),
    **{f"enum:{w}": (T.ShortType(), "int64") for w in (1, 2, 4, 8)},
}
ALIASES = {"f32": "float32", "f64": "float64", "i32": "int32", "i64": "int64", "string": "text", "str": "text", "double": "float64", "bigint": "int64", "int": "int32", "float": "float32", "boolean": "bool"}


def canonical_dtype(name: str) -> str:
    """The name that stands for a type; raises for an unknown one."""
    found = ALIASES.get(name, name)
    if found not in DTYPES:
        raise fail("dtype", f"{name!r} is not a column type.", f"use one of {', '.join(DTYPES)}.")
    return found


def accum_dtype(name: str) -> str:
    """The type in which sums of a column are kept."""
    found = DTYPES[canonical_dtype(name)][1]
    if found is None:
        raise fail("dtype", f"{name!r} has no sum.", "sum a numeric column.")
    return found


def dtype_of(t: T.DataType) -> str:
    """The name of a Spark type."""
    for name, (own, _) in DTYPES.items():
        if t == own:
            return name
    if isinstance(t, (T.ByteType, T.ShortType)):
        return "int32"
    if isinstance(t, (T.TimestampType, T.DateType)):
        return "date"
    return t.simpleString()


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def checked(c: Column, low: int, high: int, what: str) -> Column:
    """The column, or an error at run time for a value outside [low, high]."""
    return F.when(c.isNull() | c.between(low, high), c).otherwise(F.raise_error(F.concat(F.lit(f"{what}: value "), c.cast("string"), F.lit(f" is outside [{low}, {high}]. Fix: use a wider type."))))


def check_int32_range(c: Column, what: str = "int32") -> Column:
    return checked(c, *INT32, what).cast("int")


def check_overflow(c: Column, dtype: str) -> Column:
    """Narrow a column to a type; values that it cannot hold raise."""
    dtype = canonical_dtype(dtype)
    if dtype == "int32":
        return check_int32_range(c)
    if dtype.startswith("enum:"):
        return checked(c, 0, (1 << int(dtype[5:])) - 1, dtype).cast("short")
    return c.cast(DTYPES[dtype][0])


def column_schema(name: str, dtype: str, scale: float | None = None, offset: float = 0.0, encoding: str = "plain") -> dict:
    """A column's record: logical and physical type, scale and offset of a scaled integer, encoding."""
    dtype = canonical_dtype(dtype)
    return {"name": name, "logical": dtype, "physical": "int32" if scale else dtype, "scale": scale, "offset": offset, "encoding": encoding}


def is_scaled(record: dict) -> bool:
    return record.get("scale") not in (None, 0)


def schema_transform(c: Column, scale: float, offset: float = 0.0) -> Column:
    """Scaled integer of a value, rounded half to even, range-checked."""
    return check_int32_range(F.rint((c - F.lit(offset)) / F.lit(scale)).cast("long"), "schema_transform")


def schema_untransform(c: Column, scale: float, offset: float = 0.0) -> Column:
    return c * F.lit(scale) + F.lit(offset)
