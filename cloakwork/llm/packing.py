"""Bounded-space online packing of token sequences into windows.

Every partition keeps a fixed number of open windows. A document's whole windows leave at once; its rest goes to the
open window where it leaves the smallest gap (best fit). When none has room and all windows are open, the fullest
one is filled by cutting the rest there, and emitted. At the end of a partition its open windows are merged; the one
that stays short is merged with those of its neighbour partitions, a bounded number a task.

Memory: a task holds the open windows and one slice of texts. Equal inputs in equal partitions give equal rows, so a
task that is repeated after a lost executor gives what it gave before.

Defined cases: a null text is an empty one (its only id is the end id); equal rows are packed each for itself; a null
doc_id is kept as null; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import cut
from cloakwork.llm.tokens import Encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
#: Sequences of partition p are numbered from p << PART_BITS; those merged from several partitions have MERGED set.
PART_BITS, MERGED = 32, 1 << 62
#: Characters tokenized at a time.
SLICE = 1_000_000


class Windows:
    """Open windows of `size` ids, `most` at a time. put() takes a piece; full windows go to `done`."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.gaps: list[tuple[int, int]] = []  # sorted (gap, window)
        self.open: dict[int, list] = {}
        self.done: list[tuple] = []

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _emit(self, w: int, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, w, at))
            at += len(ids)

    def _place(self, w: int, gap: int, piece: tuple) -> None:
        self.open[w].append(piece)
        gap -= len(piece[2])
        if gap:
            insort(self.gaps, (gap, w))
        else:
            self._emit(w, self.open.pop(w))

    def put(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self._emit(self._new(), [(doc, start, ids[: self.size], total)])
            ids, start = ids[self.size :], start + self.size
        while len(ids):
            i = bisect_left(self.gaps, (len(ids), -1))
            if i < len(self.gaps):  # the smallest gap with room
                gap, w = self.gaps.pop(i)
                return self._place(w, gap, (doc, start, ids, total))
            if len(self.gaps) < self.most:
                w = self._new()
                self.open[w] = []
                return self._place(w, self.size, (doc, start, ids, total))
            gap, w = self.gaps.pop(0)  # the fullest
            self._place(w, gap, (doc, start, ids[:gap], total))
            ids, start = ids[gap:], start + gap

    def close(self) -> list[tuple]:
        """Merge the open windows, fullest first; the pieces of the one that stays short."""
        short: list[tuple] = []
        room = self.size
        for _, w in list(self.gaps):
            for doc, start, ids, total in self.open.pop(w):
                while len(ids) >= room:
                    self._emit(self._new(), [*short, (doc, start, ids[:room], total)])
                    ids, start, short, room = ids[room:], start + room, [], self.size
                if len(ids):
                    short.append((doc, start, ids, total))
                    room -= len(ids)
        self.gaps = []
        return short


def _rows(done: list[tuple], ids: list | None = None) -> pa.RecordBatch:
    columns = list(zip(*done)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + [pa.array(ids or [None] * len(done), pa.binary())], schema=_SCHEMA)


def _pack_part(tokenizer: str, kind: str, end_id: int, size: int, windows: int):
    def run(parts):
        encoder = Encoder.of(tokenizer, kind)
        part = TaskContext.get().partitionId()
        w = Windows(size, windows, part << PART_BITS)
        for batch in parts:
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b, ids, per in encoder.encode_slices(texts, SLICE):
                ids = ids.astype("<u4")
                ends = np.cumsum(per)
                for doc, n, e in zip(docs[a:b], per.tolist(), ends.tolist()):
                    w.put(doc, 0, np.append(ids[e - n : e], np.uint32(end_id)), n + 1)
                yield _rows(w.done)
                w.done = []
        short = w.close()
        yield _rows(w.done)
        if short:  # sequence_id is the partition until the merge
            at = np.cumsum([0] + [len(p[2]) for p in short]).tolist()
            yield _rows([(d, s, len(i), zlib.crc32(i.tobytes()), n, part, o) for (d, s, i, n), o in zip(short, at)], [p[2].tobytes() for p in short])

    return run


def _merge_group(size: int, windows: int, group: int):
    def run(parts):
        w, now = None, None
        for batch in parts:
            for row in batch.to_pylist():
                g = row["sequence_id"] // group
                if g != now:
                    if w:
                        _flush(w)
                        yield _rows(w.done)
                    w, now = Windows(size, windows, MERGED + (g << PART_BITS)), g
                w.put(row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])
        if w:
            _flush(w)
            yield _rows(w.done)

    return run


def _flush(w: Windows) -> None:
    if short := w.close():
        w._emit(w._new(), short)


def pack(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, size: int = 1024, windows: int = 32, group: int = 64) -> DataFrame:
    """Pieces of docs(doc_id, text) and where they lie: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    windows: open windows a partition; group: partitions whose last short windows are merged by one task.
    """
    spark = docs.sparkSession
    schema = PIECES + ", ids binary"
    pieces = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack_part(tokenizer, kind, end_id, size, windows), schema), "packing")
    short = pieces.where("ids is not null")
    merged = (
        short.repartition(F.floor(F.col("sequence_id") / group))
        .sortWithinPartitions(F.floor(F.col("sequence_id") / group), "sequence_id", "offset")
        .mapInArrow(_merge_group(size, windows, group), schema)
    )
    return pieces.where("ids is null").drop("ids").unionByName(merged.drop("ids"))
