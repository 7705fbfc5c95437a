"""Structured Streaming: grouped sums over arriving files, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import aggregate
from ..plans.scratch import scratch_path


def stream_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, least_bytes: int = 0) -> DataFrame:
    """A folder of Parquet files as a stream, some files at a time.

    A trigger takes ``files_per_trigger`` files, or more of small ones: as many as come to ``least_bytes`` at the mean size of those
    that are there now. What a batch costs besides its rows (log, plan, state of each partition) is some seconds on any size.
    """
    if least_bytes:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder)
        files_per_trigger = max(files_per_trigger, least_bytes * found.getFileCount() // max(1, found.getLength()))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def grouped(stream: DataFrame, keys: list[str], aggs: dict[str, tuple[str, ...]], sep: str = "_") -> DataFrame:
    """Running groups of a stream: the same aggregates as for a table, exact distinct counts excepted."""
    return stream.groupBy(*keys).agg(*(aggregate(op, c).alias(f"{c}{sep}{op}") for c, ops in aggs.items() for op in ops))


def windowed(stream: DataFrame, time: str, keys: list[str], aggs: dict[str, tuple[str, ...]], width: str, slide: str | None = None, late: str = "0 seconds", sep: str = "_") -> DataFrame:
    """Event-time windows with a watermark: groups per window, closed once events may be no more than ``late`` late."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(w, *keys).agg(*(aggregate(op, c).alias(f"{c}{sep}{op}") for c, ops in aggs.items() for op in ops))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *(f"{c}{sep}{op}" for c, ops in aggs.items() for op in ops))


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "0 seconds") -> DataFrame:
    """Sessions of each key that a gap without events ends: start, end, n."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def finished(stream: DataFrame, mode: str = "complete", label: str = "stream") -> DataFrame:
    """Run a stream over what is there now and read its result.

    Complete results are kept by the last batch as a table; appended ones as Parquet files, written exactly once.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
