"""Best-fit packing of tokenised documents into fixed-length sequences, by hierarchical residual packing.

Each task tokenises its documents into pieces; nearly full ones are sequences at once. The others (ids, places and
sizes, no text) are dealt by hash to as many tasks as keep about half a buffer in each, so a task's pieces are a mix
of the whole corpus whatever order the documents came in, and each task packs its pieces best-fit-decreasing, all at once.
Best fit leaves at most one bin of up to half the capacity in a task, and fuller ones can't join each other: what can
still be merged are these small bins, with each other or with one of as many least full others. They go to one
task, after rounds among themselves where they are more than half a buffer.

Rows: a null or empty text is one piece that holds just the end id. Repeated rows are packed as often
as they occur; a null doc_id is packed like any other. An empty table gives an empty result. Extra
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import _subwords
from framelake.llm._stage import staged
from framelake.llm._words import chunks, lean

_BIN = "final boolean, sequence_id bigint, used int, pieces array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_ARROW = pa.schema([("final", pa.bool_()), ("sequence_id", pa.int64()), ("used", pa.int32()), ("pieces", pa.list_(_PIECE))])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers by best-fit decreasing: each item goes to the fullest bin that takes it.

    Ties go to the bin opened last. Open bins are kept by the room left, and one integer holds a
    bit for each room that occurs, so finding the fullest fitting bin is one shift and one bit scan.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


class _Packer:
    """Takes items (a size and the pieces inside), gives back bins as record batches.

    A bin filled to `nearly_full` of the capacity is final, in the last round each one is.
    """

    def __init__(self, capacity: int, nearly_full: float, level: int, last: bool):
        from pyspark import TaskContext

        self.capacity, self.enough, self.last = capacity, int(capacity * nearly_full), last
        self.items: list[tuple[int, list[tuple]]] = []
        part = TaskContext.get().partitionId()
        self.next_id = (level << 56) | (part << 32)
        self.out: list[tuple[bool, int, int, list[tuple]]] = []

    def pack(self) -> Iterator[pa.RecordBatch]:
        for members in best_fit([s for s, _ in self.items], self.capacity):
            used, pieces = 0, []
            for i in members:
                for p in self.items[i][1]:
                    pieces.append((*p[:5], used))
                    used += p[3]
            self._emit(self.last or used >= self.enough, used, pieces)
            yield from self.batches()
        yield from self.batches(done=True)

    def _emit(self, final: bool, used: int, pieces: list[tuple]) -> None:
        self.out.append((final, self.next_id, used, pieces))
        self.next_id += 1

    def batches(self, done: bool = False) -> Iterator[pa.RecordBatch]:
        if self.out and (done or len(self.out) > 5000):
            final, ids, used, pieces = zip(*self.out, strict=True)
            names = [f.name for f in _PIECE]
            rows = pa.array([[dict(zip(names, p, strict=True)) for p in x] for x in pieces], _ARROW.field("pieces").type)
            self.out = []
            yield pa.RecordBatch.from_arrays([pa.array(final), pa.array(ids, pa.int64()), pa.array(used, pa.int32()), rows], schema=_ARROW)


def pieces_of(batch: pa.RecordBatch, capacity: int, vocabulary: str, end_id: int) -> Iterator[tuple]:
    """(doc_id, piece, start, length, crc32 of the ids, 0) of each piece of each document."""
    ids, off = _subwords.encode(batch.column("text"), vocabulary)
    for d, a, b in zip(batch.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
        whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
        for k, start in enumerate(range(0, len(whole), capacity)):
            part = whole[start : start + capacity]
            yield d, k, start, len(part), zlib.crc32(part.tobytes()), 0


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    vocabulary: str = _subwords.DEFAULT_VOCABULARY,
    end_id: int = 0,
    nearly_full: float = 0.995,
    buffer: int = 65536,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    vocabulary: a tokenizers file, by path or by name among the public ones. buffer: items that a task
    holds at most, which bounds its memory; shares are dealt to half of it.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, nearly_full, 0, last=False)
        for b in chunks(batches):
            for p in pieces_of(b, capacity, vocabulary, end_id):
                packer._emit(p[3] >= packer.enough, p[3], [p])
            yield from packer.batches()
        yield from packer.batches(done=True)

    def again(level: int, last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = _Packer(capacity, nearly_full, level, last)
            for b in batches:
                for used, pieces in zip(b.column("used").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                    packer.items.append((used, [tuple(p.values()) for p in pieces]))
            yield from packer.pack()

        return merge

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bins = staged(rows.mapInArrow(lean(first), _BIN))
    done, small, level = [bins.filter("final")], bins.filter("not final"), 0
    others = None  # bins over half full that are not final
    while left := small.count():
        level += 1
        parts = -(-left // max(2, buffer // 2))
        if parts == 1:  # so many of the least full others can take all that any can
            if others is not None:
                edge = others.select("used", "sequence_id").orderBy("used", "sequence_id").limit(left).agg(F.max(F.struct("used", "sequence_id"))).first()[0]
                if edge is not None:
                    near = (F.col("used") < edge["used"]) | ((F.col("used") == edge["used"]) & (F.col("sequence_id") <= edge["sequence_id"]))
                    small, others = small.union(others.filter(near)), others.filter(~near)
            done.append(small.repartition(1).mapInArrow(lean(again(level, True)), _BIN))
            break
        bins = staged(small.repartition(parts, F.xxhash64("sequence_id")).mapInArrow(lean(again(level, False)), _BIN))
        done.append(bins.filter("final"))
        half = F.col("used") * 2 <= capacity
        small, more = bins.filter(~F.col("final") & half), bins.filter(~F.col("final") & ~half)
        others = more if others is None else others.union(more)
    if others is not None:
        done.append(others)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("sequence_id", F.inline("pieces"))
