"""Bounded-space online packing of token ids into sequences.

Every task keeps a fixed number of open windows. A document's full lengths become
sequences of their own; the rest goes to the open window that it fits best. Where it fits
none and all windows are open, the fullest is filled up with the head of the rest
and emitted. What is open at the end of a task is a leftover; leftovers of a few dozen
tasks are packed again by the same rule, in as many rounds as that takes, and the last
windows are emitted in powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm.common import ready, whole_text, written
from platter.llm.tokens import encoder

OPEN_WINDOWS = 16
# Tasks whose leftovers meet: at most TASKS_TOGETHER * OPEN_WINDOWS windows in one group.
TASKS_TOGETHER = 64

_COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task long"


class Packer:
    """Open windows of one task. A piece is (document, start, doc_tokens, ids as bytes)."""

    def __init__(self, size: int, open_windows: int, first_sequence: int):
        self.size, self.most = size, open_windows
        self.open: list[list] = []  # [filled, pieces]
        self.closed: list[tuple[int, list]] = []
        self.next = first_sequence

    def _emit(self, pieces: list) -> None:
        self.closed.append((self.next, pieces))
        self.next += 1

    def place(self, document, start: int, doc_tokens: int, ids: bytes) -> None:
        length, full = len(ids) // 4, 4 * self.size
        while length >= self.size:
            self._emit([(document, start, doc_tokens, ids[:full])])
            ids, start, length = ids[full:], start + self.size, length - self.size
        if not length:
            return
        fitting = [w for w in self.open if w[0] + length <= self.size]
        if fitting:
            window = max(fitting, key=lambda w: w[0])
        elif len(self.open) < self.most:
            window = [0, []]
            self.open.append(window)
        else:
            fullest = max(self.open, key=lambda w: w[0])
            room = self.size - fullest[0]
            fullest[1].append((document, start, doc_tokens, ids[: 4 * room]))
            self.open.remove(fullest)
            self._emit(fullest[1])
            self.place(document, start + room, doc_tokens, ids[4 * room :])
            return
        window[0] += length
        window[1].append((document, start, doc_tokens, ids))
        if window[0] == self.size:
            self.open.remove(window)
            self._emit(window[1])

    def finish(self) -> None:
        """Emits what is open: windows filled up from each other, the last one cut into powers of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        left, self.open = sum(len(p[3]) // 4 for p in pieces), []
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= room
            sequence = []
            while room:
                document, start, doc_tokens, ids = pieces.pop(0)
                take = min(room, len(ids) // 4)
                sequence.append((document, start, doc_tokens, ids[: 4 * take]))
                if 4 * take < len(ids):
                    pieces.insert(0, (document, start + take, doc_tokens, ids[4 * take :]))
                room -= take
            self._emit(sequence)

    def rows(self, id_type: pa.DataType, task: int, leftovers: bool = False) -> pa.RecordBatch:
        """The closed windows as rows, or the open ones with their ids, for the next round."""
        if leftovers:
            windows = [(None, pieces) for _, pieces in self.open]
        else:
            windows, self.closed = self.closed, []
        out: list[list] = [[] for _ in range(9)]
        for sequence, pieces in windows:
            offset = 0
            for document, start, doc_tokens, ids in pieces:
                length = len(ids) // 4
                row = (document, start, length, zlib.crc32(ids), doc_tokens, sequence, offset, ids if leftovers else None, task)
                for column, value in zip(out, row):
                    column.append(value)
                offset += length
        types = [id_type, *[pa.int64()] * 6, pa.binary(), pa.int64()]
        names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "task"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    size: int = 2048,
    open_windows: int = OPEN_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and `end_id`; each id lies in exactly one piece. Null texts
    count as empty (only the end id). Ids may be null or repeated: every row is a document
    of its own. Other columns are ignored; an empty table gives no piece. A sequence id
    holds the round, the task or group, and a running number.
    """
    ready(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode_batch
        task = TaskContext.get().partitionId()
        packer, id_type = Packer(size, open_windows, task << 32), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for document, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += end
                packer.place(document, 0, len(ids) // 4, ids)
            yield packer.rows(id_type, task)
        if id_type is not None:
            yield packer.rows(id_type, task, leftovers=True)

    given = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    schema = f"_id {given.schema['_id'].dataType.simpleString()}, {_COLUMNS}"
    packed = written(given.mapInArrow(first, schema), "packed")
    parts, rest, level = [packed.filter("ids IS NULL")], packed.filter("ids IS NOT NULL"), 1
    while True:
        groups = rest.agg(F.max("task")).first()[0]
        if groups is None:
            break
        last = groups < TASKS_TOGETHER
        packed = written(_merge_round(rest, schema, size, open_windows, level, last), "packed")
        parts.append(packed.filter("ids IS NULL"))
        if last:
            break
        rest, level = packed.filter("ids IS NOT NULL"), level + 1
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.drop("ids", "task").withColumnRenamed("_id", id_col)


def _merge_round(rest: DataFrame, schema: str, size: int, open_windows: int, level: int, last: bool) -> DataFrame:
    """Packs the leftovers of every TASKS_TOGETHER tasks again; in the last round nothing stays open."""

    def merge(key: tuple, batch: pa.Table) -> pa.Table:
        group = key[0].as_py()
        packer = Packer(size, open_windows, (level << 58) | (group << 32))
        rows = batch.sort_by([("length", "descending"), ("_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        columns = [rows.column(c).to_pylist() for c in ("_id", "start", "doc_tokens", "ids")]
        for piece in zip(*columns):
            packer.place(*piece)
        if last:
            packer.finish()
        id_type = rows.schema.field("_id").type
        return pa.Table.from_batches([packer.rows(id_type, group), packer.rows(id_type, group, leftovers=True)])

    grouped = rest.withColumn("_group", F.floor(F.col("task") / TASKS_TOGETHER).cast("long"))
    return grouped.groupBy("_group").applyInArrow(merge, schema)
