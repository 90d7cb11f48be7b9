"""Bounded-space online packing of tokenised documents into fixed windows.

Each task reads its documents in order and holds a fixed number of open windows. A document of more than a window
fills whole windows of its own and leaves a remainder. A piece goes to the open window that it fills best; where none
has room, the fullest is emitted and a new one opened. What is open when a task ends is merged: the leftovers of a
fixed number of neighbouring tasks are packed anew, largest piece first, each into the window that it fills best.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.bpe import blocks, encoder, vocabulary_bytes
from provena.llm.common import materialize

WINDOW = 4096
OPEN = 64  # windows a task holds open
TOGETHER = 32  # neighbouring tasks whose leftovers are merged by one task

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class OpenWindows:
    """At most `most` open windows; place() returns the windows that it had to emit."""

    def __init__(self, window: int, most: int | None):
        self.window, self.most = window, most
        self.room: list[tuple[int, int]] = []  # (tokens free, number of the window), rising
        self.pieces: dict[int, list[tuple]] = {}
        self.opened = 0

    def place(self, piece: tuple, length: int) -> list[tuple[int, list[tuple]]]:
        out = []
        at = bisect.bisect_left(self.room, (length, -1))
        if at < len(self.room):
            free, number = self.room.pop(at)
        else:
            if self.most is not None and len(self.room) >= self.most and length < self.window:
                fullest = self.room.pop(0)[1]
                out.append((fullest, self.pieces.pop(fullest)))
            free, number = self.window, self.opened
            self.opened += 1
            self.pieces[number] = []
        self.pieces[number].append((*piece, self.window - free))
        if free > length:
            bisect.insort(self.room, (free - length, number))
        else:
            out.append((number, self.pieces.pop(number)))
        return out


def _pack(own, end_id: int, window: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pieces; sequence_id counts the task's windows, left is true for windows still open at its end."""
    part = TaskContext.get().partitionId()
    open_, end = OpenWindows(window, most), np.array([end_id], np.uint32).tobytes()
    rows: list[tuple] = []

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) if done else [[]] * 8
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.bool_()), pa.array([part] * len(done), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, [*NAMES, "left", "part"])

    for batch, texts in blocks(batches):
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode_block(texts), strict=True):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, window):
                length = min(window, n - start)
                piece = (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n)
                for number, pieces in open_.place(piece, length):
                    rows += [(*p[:5], number, p[5], False) for p in pieces]
        yield batch_of(rows)
        rows = []
    yield batch_of([(*p[:5], number, p[5], True) for number, pieces in open_.pieces.items() for p in pieces])


def _merge(window: int, table: pa.Table) -> pa.Table:
    order = [("length", "descending"), ("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")]
    table = table.sort_by(order)
    group = table.column("part")[0].as_py() // TOGETHER
    open_, done = OpenWindows(window, None), []
    for row in zip(*(table.column(c).to_pylist() for c in NAMES[:5]), strict=True):
        done += open_.place(row, row[2])
    done += open_.pieces.items()
    rows = [(*p[:5], (1 << 62) + (group << 32) + number, p[5]) for number, pieces in done for p in pieces]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], NAMES)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = WINDOW, most: int = OPEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids with end_id after them are cut only where they exceed a window, so each id lies in one
    piece. Null and empty texts are the end id alone; repeated rows are packed each; a null id stays null; other
    columns are ignored. Texts of any length are cut over as many windows as they need; no documents give no rows. The pieces, a few numbers each, are written once; only leftovers are shuffled, a fixed
    number of windows per task.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    made = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        lambda it: _pack(encoder(sent.value), end_id, window, most, it), SCHEMA + ", left boolean, part long"
    )
    made = materialize(made, "packed")
    full = made.filter("not left").withColumn("sequence_id", F.col("part") * F.lit(1 << 32) + F.col("sequence_id")).select(*NAMES)
    left = made.filter("left").groupBy(F.floor(F.col("part") / TOGETHER)).applyInArrow(lambda table: _merge(window, table), SCHEMA)
    return full.unionByName(left)
