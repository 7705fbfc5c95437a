"""Packing: bounded-space online best fit into fixed-length sequences.

Each partition keeps at most ``open_windows`` open windows. A piece goes where it leaves the least room (best fit); if it fits
nowhere and all windows are open, the fullest window takes as much of the piece as it has room for and is emitted, and the rest
of the piece is placed in turn. So an emitted window is full. What partitions leave open is merged the same way, ``fan_in``
partitions to a task, level by level, until one task strings the last windows together; only the last sequence has padding. A task holds
``open_windows`` windows and a batch of texts, whatever the input's size, and no level moves more than the windows left open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, texts_of, to_batch, written
from .tokens import encoder

_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, part long, sequence long, offset long, done boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64()), ("done", pa.bool_())])


class Packer:
    """Windows of one partition. ``place`` and ``close`` append finished rows to ``rows``."""

    def __init__(self, part: int, capacity: int, open_windows: int):
        self.part, self.capacity, self.most = part, capacity, open_windows
        self.windows: list[list] = []  # [room, [(doc_id, start, tokens of the document, ids)]]
        self.emitted = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple], done: bool = True) -> None:
        at = 0
        for doc_id, start, whole, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, whole, ids, self.part, self.emitted, at, done))
            at += n
        self.emitted += 1

    def place(self, doc_id: int, start: int, whole: int, ids: bytes) -> None:
        full = 4 * self.capacity
        while ids:
            if len(ids) >= full:
                self._emit([(doc_id, start, whole, ids[:full])])
                start, ids = start + self.capacity, ids[full:]
                continue
            n = len(ids) // 4
            best = min((w for w in self.windows if w[0] >= n), key=lambda w: w[0], default=None)
            if best is None and len(self.windows) < self.most:
                best = [self.capacity, []]
                self.windows.append(best)
            if best is None:
                best = min(self.windows, key=lambda w: w[0])
                n = best[0]
            best[1].append((doc_id, start, whole, ids[: 4 * n]))
            best[0] -= n
            start, ids = start + n, ids[4 * n :]
            if not best[0]:
                self.windows.remove(best)
                self._emit(best[1])

    def close(self, last: bool) -> None:
        """Emit what is open; at the last merge strung together and cut anew, so that one sequence at most has padding."""
        groups = [pieces for _, pieces in self.windows]
        if last:
            room, groups, open_pieces = 0, [], [p for pieces in groups for p in pieces]
            for doc_id, start, whole, ids in open_pieces:
                while ids:
                    if not room:
                        room, groups = self.capacity, [*groups, []]
                    n = min(room, len(ids) // 4)
                    groups[-1].append((doc_id, start, whole, ids[: 4 * n]))
                    room, start, ids = room - n, start + n, ids[4 * n :]
        for pieces in groups:
            self._emit(pieces, last)
        self.windows = []

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield to_batch(self.rows, _ARROW)
            self.rows = []


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, open_windows: int = 32, fan_in: int = 32, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, remembered: int = 400_000, at_once: int = 1024) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset.

    Each token, with the end id after each document, lies in exactly one piece. A null or empty text is the end id alone. Rows
    that repeat an id are packed each for itself. An empty table gives no pieces. Other columns are not read. Sequences hold
    ``capacity`` tokens, save the very last, which is padded when used. ``remembered`` pieces and ``at_once`` texts bound the
    encoder's memory; they have no bearing on the result.
    """

    def first(batches):
        e, end = encoder(tokenizer, remembered), end_id.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId(), capacity, open_windows)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), at_once):
                for doc_id, x in zip(ids[at : at + at_once], e.encode(texts_of(batch.slice(at, at_once), 1))):
                    packer.place(doc_id, 0, len(x) // 4 + 1, x + end)
                yield from packer.batches()
        packer.close(False)
        yield from packer.batches()

    def merge(base: int, last: bool):
        def run(batches):
            packer = None
            for batch in batches:
                for doc_id, start, whole, ids, group in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "group"))):
                    if packer is None or packer.part != base + group:
                        if packer:
                            packer.close(last)
                            yield from packer.batches()
                        packer = Packer(base + group, capacity, open_windows)
                    packer.place(doc_id, start, whole, ids)
                if packer:
                    yield from packer.batches()
            if packer:
                packer.close(last)
                yield from packer.batches()

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    level = written(rows.mapInArrow(lean(first), _SCHEMA), "pack")
    out, base = level.filter("done"), 0
    parts = (level.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups = -(-parts // fan_in)
        left = level.filter("not done").withColumn("group", F.floor((F.col("part") - base) / fan_in))
        base += parts
        tasks = left.repartition(groups, "group").sortWithinPartitions("group", "part", "sequence", "offset")
        level = written(tasks.mapInArrow(lean(merge(base, groups == 1)), _SCHEMA), "pack")
        out = out.unionByName(level.filter("done"))
        if groups == 1:
            break
        parts = groups
    return out.select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("part") * (1 << 31) + F.col("sequence")).alias("sequence_id"), "offset")
