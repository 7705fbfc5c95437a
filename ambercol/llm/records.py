"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A shard is a file of records. A record is
``length (u64 LE) | masked crc32 of the length (u32 LE) | payload | masked crc32 of the payload (u32 LE) | 0x0A``
with payload ``doc_id (i64 LE) | bytes per id (u8) | ids (u16 or u32 LE)``; the highest bit of the u8 marks a null doc_id, written
as 0. A checksum is masked by rotating it right by 15 bits
and adding 0xA282EAD8, so that a checksum over bytes that hold checksums stays strong. Shards are in ascending doc_id order, null
ids first, by file name and within a file. The index is a Parquet table with a row per record: shard, offset, length, doc_id, n_tokens.

Spark's text writer, which puts its separator 0x0A after each record, writes the shards: its commit protocol keeps exactly one
attempt of each task, on any store that Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, lean, scratch_path, texts_of, to_batch
from .tokens import encoder

_INDEX = "shard string, offset long, length long, doc_id long, n_tokens long"
_HEAD, _HEAD_BYTES = "<QI", 12
_ITEM, _ITEM_BYTES = "<qB", 9
_NO_ID = 0x80
#: Characters of text for a shard, and so about the memory that reading one takes.
SHARD_CHARS = 24_000_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """A record without its end byte."""
    payload = struct.pack(_ITEM, doc_id or 0, width | (_NO_ID if doc_id is None else 0)) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def _item(data: memoryview | bytes, at: int = 0) -> tuple[int | None, int]:
    """doc_id and bytes per id of a payload."""
    doc_id, width = struct.unpack_from(_ITEM, data, at)
    return (None, width & ~_NO_ID) if width & _NO_ID else (doc_id, width)


def headers(data: memoryview, name: str = "shard") -> Iterator[tuple[int, int]]:
    """(offset, payload length) of each record; raises ValueError where a length's checksum fails or a record is cut off."""
    at, n = 0, len(data)
    while at < n:
        if at + _HEAD_BYTES > n:
            raise ValueError(f"read_records: {name} ends within a record at byte {at}. Fix: write the shard again.")
        length, crc = struct.unpack_from(_HEAD, data, at)
        if masked(bytes(data[at : at + 8])) != crc or at + _HEAD_BYTES + length + 5 > n:
            raise ValueError(f"read_records: bad length at byte {at} of {name}. Fix: write the shard again.")
        yield at, length
        at += _HEAD_BYTES + length + 5


def unframe(data: memoryview, at: int, length: int, name: str = "shard") -> tuple[int | None, np.ndarray]:
    """doc_id and ids of the record at an offset; raises ValueError where the payload's checksum fails."""
    begin = at + _HEAD_BYTES
    payload = bytes(data[begin : begin + length])
    if masked(payload) != struct.unpack_from("<I", data, begin + length)[0]:
        raise ValueError(f"read_records: bad payload at byte {at} of {name}. Fix: write the shard again.")
    doc_id, width = _item(payload)
    return doc_id, np.frombuffer(payload, f"<u{width}", offset=_ITEM_BYTES)


def write_records(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode whole texts, append ``end_id`` and write shards to ``path/shards`` in ascending id order, the index to ``path/index``.

    A null text is empty and gives the end id alone; rows with a null id come first. Rows that repeat an id each give a record;
    their order among themselves is that of their texts' hashes, by which they are also dealt out, so that no id is one shard. An
    empty table gives no records. Other columns are not read. A hot source has no bearing on the shards.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_CHARS))
    ordered = rows.repartitionByRange(parts, "i", "h").sortWithinPartitions("i", "h").select("i", "t")

    def encode(batches):
        e = encoder(tokenizer, 250_000)  # beside sorted texts an executor has less room
        width = 2 if e.size <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("r", pa.binary())])
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                part = batch.slice(at, 256)
                encoded = e.encode(texts_of(part, 1))
                yield to_batch([(frame(i, np.frombuffer(x + end, "<u4"), width),) for i, x in zip(ids[at : at + 256], encoded)], schema)

    ordered.mapInArrow(lean(encode), "r binary").select(F.col("r").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/shards")
    build_index(spark, path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/shards").select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")


def build_index(spark: SparkSession, path: str) -> None:
    """Write the offset index of the shards below ``path`` from the records' headers."""

    def index(batches):
        schema = pa.schema([("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                view, rows = memoryview(data.as_buffer()), []
                for at, length in headers(view, name):
                    doc_id, width = _item(view, at + _HEAD_BYTES)
                    rows.append((name, at, length, doc_id, (length - _ITEM_BYTES) // width))
                if rows:
                    yield to_batch(rows, schema)

    _shards(spark, path).mapInArrow(lean(index), _INDEX).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with ``start``, the tokens of all records before each one; no rows for an empty table.

    A shard's own start is a running sum over the shards, one row for each; within a shard it is one over its records.
    """
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return index.withColumn("within", within).join(bounded(before, "shards"), "shard").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def read_records(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Read records back: shard, offset, doc_id, ids (little-endian unsigned 32-bit bytes), each checksum verified.

    ``wanted`` picks records in any order: a table with the index's columns shard and offset, whose offsets are gathered by
    shard (a shard's offsets are bounded by its size), so that a shuffled read opens each shard that it needs once. Offsets that
    repeat give their record again; a null doc_id is read as null.
    """
    schema = pa.schema([("shard", pa.string()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    shards = _shards(spark, path)
    if wanted is not None:
        shards = shards.join(wanted.groupBy("shard").agg(F.collect_list("offset").alias("offsets")), "shard")

    def read(batches):
        for batch in batches:
            picked = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for name, data, offsets in zip(batch.column(0).to_pylist(), batch.column(1), picked):
                view, rows = memoryview(data.as_buffer()), []
                places = headers(view, name) if offsets is None else ((at, struct.unpack_from(_HEAD, view, at)[0]) for at in offsets)
                for at, length in places:
                    doc_id, ids = unframe(view, at, length, name)
                    rows.append((name, at, doc_id, ids.astype("<u4").tobytes()))
                    if len(rows) == 256:
                        yield to_batch(rows, schema)
                        rows = []
                if rows:
                    yield to_batch(rows, schema)

    return shards.mapInArrow(lean(read), "shard string, offset long, doc_id long, ids binary")


def record_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' records, read the files back, and give each record's place and checksum; edge cases as in ``write_records``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "records")
    write_records(docs, path, tokenizer)
    got = read_records(spark, path).select("shard", "offset", "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    placed = read_index(spark, path).select("shard", "offset", "start")
    return got.join(placed, ["shard", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")
