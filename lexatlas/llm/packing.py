"""Bounded-space online packing of documents into fixed-length sequences.

Each partition keeps at most `windows` open sequences. A document's ids first fill whole sequences; what remains goes
to the fullest open sequence that still takes it (best fit). When none does and all windows are taken, the fullest is
emitted. The sequences still open at the end of each partition are leftovers: a second pass joins those of several
partitions into one stream and cuts it every `length` ids, so that each of its tasks pads one sequence at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm.arrays import list_crc32, text_blocks
from lexatlas.llm.tokens import encoder
from lexatlas.sources.workspace import map_arrow, materialize

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("full", pa.bool_()), ("ids", pa.list_(pa.int32()))])
#: Sequence ids: the task's number above, its own count below; those of the second pass have this bit.
_SHIFT, _SECOND = 32, 1 << 61
#: Partitions whose leftovers one task of the second pass joins.
FAN_IN = 16


class _Rows:
    """Pieces to be written, as columns."""

    def __init__(self) -> None:
        self.meta: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, sequence: int, pieces: list[tuple], full: bool) -> None:
        offset = 0
        for doc_id, start, doc_tokens, ids in pieces:
            self.meta.append((doc_id, start, len(ids), doc_tokens, sequence, offset, full))
            self.ids.append(ids)
            offset += len(ids)
        self.size += offset

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.meta), _SCHEMA)]
        ends = np.cumsum([0, *map(len, self.ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(self.ids).astype(np.int32)))
        self.__init__()
        return pa.RecordBatch.from_arrays([*columns, lists], schema=_SCHEMA)


class Windows:
    """At most `windows` open sequences of at most `length` ids each."""

    def __init__(self, length: int, windows: int):
        self.length, self.windows = length, windows
        self.open: list[list[tuple]] = []
        self.room = np.zeros(0, np.int64)

    def put(self, piece: tuple) -> list[tuple] | None:
        """Places a piece shorter than a sequence; the sequence that is complete or had to go, if any."""
        n = len(piece[3])
        fits = np.where(self.room >= n, self.room, self.length + 1)
        gone = None
        if len(fits) and fits[best := int(fits.argmin())] <= self.length:
            self.open[best].append(piece)
            self.room[best] -= n
            return self.take(best) if self.room[best] == 0 else None
        if len(self.open) == self.windows:
            gone = self.take(int(self.room.argmin()))
        self.open.append([piece])
        self.room = np.append(self.room, self.length - n)
        return gone

    def take(self, at: int) -> list[tuple]:
        self.room = np.delete(self.room, at)
        return self.open.pop(at)


def _first(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int, windows: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << _SHIFT
    own, rows, count = Windows(length, windows), _Rows(), 0
    for batch, text in text_blocks(batches):
        flat, offsets = encoder(path).encode(text)
        for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            ids = np.append(flat[a:b], np.uint32(end_id))
            total = len(ids)
            whole = total - total % length
            for start in range(0, whole, length):
                rows.add(task + count, [(doc_id, start, total, ids[start : start + length])], True)
                count += 1
            if whole < total and (done := own.put((doc_id, whole, total, ids[whole:]))):
                rows.add(task + count, done, True)
                count += 1
        if rows.size > 1 << 18:
            yield rows.batch()
    for left in own.open:
        rows.add(task + count, left, False)
        count += 1
    if rows.meta:
        yield rows.batch()


def _second(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    task, count, used, rows = _SECOND + (TaskContext.get().partitionId() << _SHIFT), 0, 0, _Rows()
    pieces: list[tuple] = []
    for batch in batches:
        for doc_id, start, total, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
            while ids:
                part, ids = ids[: length - used], ids[length - used :]
                pieces.append((doc_id, start, total, np.array(part, np.int32)))
                start, used = start + len(part), used + len(part)
                if used == length:
                    rows.add(task + count, pieces, True)
                    pieces, used, count = [], 0, count + 1
        if rows.size > 1 << 18:
            yield rows.batch()
    if pieces:
        rows.add(task + count, pieces, True)
    if rows.meta:
        yield rows.batch()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, windows: int = 64) -> DataFrame:
    """Packs the documents (doc_id, text; other columns are ignored) into sequences of at most `length` ids.

    A document is its tokenizer ids without special tokens, then end_id; a null text counts as empty, so that it is
    end_id alone. Each id lies in exactly one piece. Rows that repeat, doc_ids that repeat and null doc_ids are
    packed like any others. Of open sequences with equally little room the one opened first takes a piece, and goes first
    when all windows are taken. Returns a row per piece: doc_id, start (ids of its document before it), length,
    doc_tokens, sequence_id, offset (ids of its sequence before it), ids. An empty table gives no rows.

    The first pass is one map over the scan; its result is written once, since the second pass reads it again.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = materialize(map_arrow(kept, lambda it: _first(it, tokenizer, end_id, length, windows), PIECES.replace("ids", "full boolean, ids", 1)), "packed")
    left = first.where(~F.col("full"))
    owner = F.shiftright("sequence_id", _SHIFT).cast("int")
    tasks = max(1, -(-docs.rdd.getNumPartitions() // FAN_IN))
    left = left.repartitionById(tasks, F.pmod(owner, F.lit(tasks))).sortWithinPartitions("sequence_id", "offset")
    second = map_arrow(left, lambda it: _second(it, length), PIECES.replace("ids", "full boolean, ids", 1))
    return first.where("full").unionByName(second).drop("full")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of their ids."""
    names = [c for c in pieces.columns if c != "ids"]

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(list_crc32(b.column("ids")))], names=[*names, "ids_crc32"])

    return map_arrow(pieces, crc, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "ids") + ", ids_crc32 long")


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids padded to `length`, n_tokens (ids that aren't padding)."""
    own = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return own.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), (F.lit(length) - F.col("n_tokens")).cast("int"))).alias("ids"), "n_tokens")
