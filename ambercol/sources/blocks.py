"""Stored tables: a plain Parquet table, and one dealt into blocks of rows that are read one by one or as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import fail
from ..plans.order import ranked


def persist_table(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def build_blocks(df: DataFrame, path: str, order_by: list[str], block_rows: int = 1_000_000, limit_rows: int | None = None, resume: bool = False) -> None:
    """Write rows in order into blocks of ``block_rows``, a folder each, with their place within the block.

    With ``resume`` blocks that are there already stay and only the others are written, so a broken build can be taken up again.
    """
    if block_rows < 1:
        raise fail("build_blocks", f"block_rows is {block_rows}.", "use 1 or more.")
    rows = ranked(df, order_by, "row")
    if limit_rows is not None:
        rows = rows.filter(F.col("row") < limit_rows)
    rows = rows.withColumn("block", F.floor(F.col("row") / block_rows))
    mode = "error"
    if resume:
        mode = "append"
        try:
            done = df.sparkSession.read.parquet(path).select("block").distinct()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            rows = rows.join(done, "block", "left_anti")
    rows.repartition("block").sortWithinPartitions("block", "row").write.partitionBy("block").mode(mode).parquet(path)


def build_blocks_from_csv(spark: SparkSession, csv: str, path: str, schema: str | T.StructType, block_rows: int = 1_000_000, limit_rows: int | None = None, resume: bool = False) -> None:
    """Blocks of a CSV file with a header, in the file's order."""
    df = spark.read.csv(csv, header=True, schema=schema).withColumn("line", F.monotonically_increasing_id())
    build_blocks(df, path, ["line"], block_rows, limit_rows, resume)


@dataclass(frozen=True)
class Blocks:
    """A block table opened for reading. Reading a block opens its folder only."""

    spark: SparkSession
    path: str
    mode: str = "lazy"
    budget_bytes: int | None = None

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.table().columns if c not in ("block", "row")]

    def index(self) -> DataFrame:
        """block, rows, first and last row; from Parquet footers and folder names, no data column is read."""
        return self.table().groupBy("block").agg(F.count("*").alias("rows"), F.min("row").alias("first"), F.max("row").alias("last"))

    @property
    def nblocks(self) -> int:
        return self.table().select("block").distinct().count()

    def read_block(self, i: int) -> DataFrame:
        """The rows of block ``i`` in order."""
        if isinstance(i, bool) or not isinstance(i, int) or i < 0:
            raise fail("read_block", f"block is {i!r}.", "use an int of 0 or more.")
        return self.table().filter(F.col("block") == i).orderBy("row")

    def __iter__(self) -> Iterator[DataFrame]:
        for r in self.table().select("block").distinct().orderBy("block").collect():  # a row for each folder
            yield self.read_block(r.block)

    @property
    def nrows(self) -> int:
        return self.table().count()

    def read(self) -> DataFrame:
        """All rows in order, in mode 'full'; refused where they are over the budget, as blocks can be read instead."""
        if self.mode != "full":
            raise fail("read", "the table was opened lazily.", "iterate over its blocks, or open it with mode='full'.")
        if self.budget_bytes is not None and self.plan()["nchunks"] > 1:
            raise fail("read", f"the rows are over the budget of {self.budget_bytes} bytes.", "open it with mode='lazy', or raise the budget.")
        return self.table().orderBy("block", "row")

    def plan(self, budget_bytes: int | None = None, row_bytes: int = 64) -> dict:
        """How many blocks fit a budget (that of the opening, if none is given) at once, and in how many rounds all are read."""
        budget_bytes = self.budget_bytes if budget_bytes is None else budget_bytes
        if budget_bytes is None:
            raise fail("plan", "there is no budget.", "pass budget_bytes here or to open_stream.")
        sizes = self.index().agg(F.count("*").alias("n"), F.max("rows").alias("most")).first()
        each = max(1, budget_bytes // max(1, (sizes.most or 1) * row_bytes))
        return {"nblocks": sizes.n, "blocks_per_chunk": min(each, max(1, sizes.n)), "nchunks": -(-sizes.n // each) if sizes.n else 0}

    def describe(self) -> str:
        return json.dumps({"path": self.path, "columns": self.columns, "nblocks": self.nblocks})


def open_blocks(spark: SparkSession, path: str, mode: str = "lazy", budget_bytes: int | None = None) -> Blocks:
    if mode not in ("lazy", "full"):
        raise fail("open_stream", f"mode is {mode!r}.", "use 'lazy' or 'full'.")
    return Blocks(spark, path, mode, budget_bytes)


def resident_prepare(df: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """Encode columns once: per column ``prefix`` (number codes), ``encoding`` 'date' or 'dictionary', or ``dtype``."""
    from ..functions.dates import date_encode
    from ..functions.text import encode_pattern
    from ..operators.dictionaries import encode
    from ..types import check_overflow

    for name, how in spec.items():
        if "prefix" in how:
            df = df.withColumn(name, encode_pattern(F.col(name), how["prefix"]))
        elif how.get("encoding") == "date":
            df = df.withColumn(name, date_encode(F.col(name)))
        elif how.get("encoding") == "dictionary":
            df = encode(df, name, "__encoded").drop(name).withColumnRenamed("__encoded", name)
        elif "dtype" in how:
            df = df.withColumn(name, check_overflow(F.col(name), how["dtype"]))
        else:
            raise fail("resident_prepare", f"{name!r} has no encoding.", "pass prefix, encoding or dtype.")
    return df
