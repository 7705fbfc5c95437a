"""Client data to DataFrames and back. NaN of NumPy and pandas floats becomes NULL; Arrow's NaN stays a value."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import fail


def from_arrow(spark: SparkSession, t: pa.Table, names: list[str] | None = None, position: str | None = None) -> DataFrame:
    """Columns in order; ``position`` adds the row number, on which positional operators can then be ordered."""
    names = names or t.column_names
    if len(names) != t.num_columns or len(set(names)) != len(names):
        raise fail("from_arrow", f"{len(names)} names for {t.num_columns} columns, or a name twice.", "name each column once.")
    t = t.rename_columns(names)
    if position:
        t = t.append_column(position, pa.array(np.arange(t.num_rows), pa.int64()))
    return spark.createDataFrame(t)


def from_pandas(spark: SparkSession, frame: pd.DataFrame, names: list[str] | None = None, position: str | None = None) -> DataFrame:
    return from_arrow(spark, pa.Table.from_pandas(frame, preserve_index=False), names, position)


def from_numpy(spark: SparkSession, a: np.ndarray | np.ma.MaskedArray, names: list[str] | str | None = None, validity: np.ndarray | None = None, position: str | None = None) -> DataFrame:
    """A vector as one column, a matrix as one for each of its columns. Masked and NaN entries are NULL."""
    if a.ndim not in (1, 2):
        raise fail("from_numpy", f"the array has {a.ndim} dimensions.", "pass a vector or a matrix.")
    lanes = [a] if a.ndim == 1 else [a[:, k] for k in range(a.shape[1])]
    names = [names] if isinstance(names, str) else names or (["value"] if a.ndim == 1 else [f"c{k}" for k in range(len(lanes))])
    columns = []
    for lane in lanes:
        gone = np.ma.getmaskarray(lane).copy()
        plain = np.ma.getdata(lane)
        if plain.dtype.kind == "f":
            gone |= np.isnan(plain)
        if plain.dtype.kind == "u" and plain.size and plain.max() > np.iinfo(np.int64).max:
            raise fail("from_numpy", "an unsigned value passes 64 signed bits.", "use a smaller type.")
        if plain.dtype.kind == "u":
            plain = plain.astype(np.int64)
        if validity is not None:
            gone |= ~validity
        columns.append(pa.array(plain.tolist() if plain.dtype.kind in "OU" else plain, mask=gone))
    return from_arrow(spark, pa.Table.from_arrays(columns, names=list(names)), position=position)


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def to_pandas(df: DataFrame) -> pd.DataFrame:
    """Nullable types, so that an integer NULL stays one."""
    return df.toArrow().to_pandas(types_mapper={pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype()}.get)


def to_masked(df: DataFrame, column: str) -> np.ma.MaskedArray:
    lane = df.select(column).toArrow().column(0).combine_chunks()
    gone = np.asarray(lane.is_null())
    filled = lane.fill_null("" if pa.types.is_string(lane.type) or pa.types.is_large_string(lane.type) else 0)
    return np.ma.masked_array(np.asarray(filled), gone)


def to_numpy(df: DataFrame, column: str, fill: bool = False) -> np.ndarray:
    """A float column's NULL as NaN. An integer's NULL has no value of its own: refused, or 0 with ``fill``."""
    masked = to_masked(df, column)
    if not masked.mask.any():
        return masked.data
    if masked.dtype.kind == "f":
        return masked.filled(np.nan)
    if not fill:
        raise fail("to_numpy", f"{column!r} holds NULLs.", "use to_masked or to_pandas, or fill=True for zeros.")
    return masked.filled(0 if masked.dtype.kind != "U" else "")
