"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is absent, as in local tests, a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("shared_dir: spark.checkpoint.dir is not set. Fix: set it to a folder that all executors share.")
        _LOCAL[app] = tempfile.mkdtemp(prefix="ambercol-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/ambercol/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write a DataFrame as Parquet to the shared folder and read it again.

    What is lost with an executor is read from the files, not computed anew.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, label: str, most_rows: int = 300_000, weight: str | None = None) -> DataFrame:
    """A table of short rows, written, and marked for broadcast only if it has shown to be small.

    It has at most ``most_rows`` rows then (with ``weight``, an expression, that sum to at most four times as much). A larger one
    is joined as Catalyst sees fit, by shuffling both sides.
    """
    df = written(df, label)
    rows, sum_of = df.agg(F.count("*"), F.sum(F.expr(weight or "1"))).first()
    return F.broadcast(df) if rows <= most_rows and (sum_of or 0) <= 4 * most_rows else df
