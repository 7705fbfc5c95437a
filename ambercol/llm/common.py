"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.scratch import bounded, scratch_path, shared_dir, written

__all__ = ["LOWER", "WORDS", "arrow_rows", "bounded", "lean", "scratch_path", "shared_dir", "table", "texts_of", "to_batch", "unused", "written"]

#: bytes.translate table: A-Z become a-z, all else stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same, and each ASCII character that is neither a letter nor a digit becomes a space.
WORDS = bytes(LOWER[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that a table does not have, in any case of their letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lean(run):
    """A mapInArrow function that gives the memory of its batches back when a partition is done."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def texts_of(batch: pa.RecordBatch, column: int | str) -> list[str]:
    """The strings of a column, null as the empty string."""
    return [x or "" for x in batch.column(column).to_pylist()]


def arrow_rows(batches: Iterable[pa.RecordBatch], rows_of, schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    """Turn each batch into rows with ``rows_of`` and yield them as Arrow batches of bounded size."""
    rows: list[tuple] = []
    for batch in batches:
        for row in rows_of(batch):
            rows.append(row)
            if len(rows) >= most:
                yield to_batch(rows, schema)
                rows = []
    if rows:
        yield to_batch(rows, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
