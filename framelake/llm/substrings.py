"""Exact removal of long repeated word sequences, by prefix-partitioned suffix trees.

A word sequence of `window` words that starts at two places of the corpus is repeated; every word it
covers goes. The trees hold sampled suffixes, each with the few words before it:

1. A window's anchor is the start of the least hash among its `anchor`-word sequences, so equal windows have equal
   anchors at the same place in them, and a suffix from each anchor (one position in ten) sees every window. A
   suffix's prefix is its first `anchor` words. Prefixes are counted over the whole corpus.
2. Prefixes that occur once need no tree; those that occur again go into a Bloom filter of a fixed size. It only saves
   work: where it says yes wrongly, or is too small for the corpus, more suffixes go on and the result is the same.
3. The suffixes that are left are dealt out by their prefix. A prefix with more than `group` suffixes is too much for a
   task: it is lengthened to the whole window, which gives a group for each window. Suffixes that a task has met with
   the same words all around in one chunk of text (about 1 MB) go out once and are answered at once, so a group of copies costs a row for
   each chunk and not for each copy.
4. A task builds the trees of its suffixes: sorted suffixes and the words that neighbours have in common. An internal
   node of depth d holds the suffixes that share d words; those of them that also share the `window` - d words before are
   a repeat that extends to both sides. Every depth from `anchor` to `window` is looked at, so all repeated windows are
   found, and overlapping ones add up to the maximal repeat.
5. The covered ranges meet their texts by doc_id and text hash.

Words are compared by 32 bits of their hashes: two windows that differ in one word alone are taken as equal with a probability of 2^-32.

Rows: a null text has no words. Repeated rows, also those with the same or a null doc_id, repeat each other, and each row is
cut by its own text. Very long texts are suffixes like all others. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._stage import slots, staged
from framelake.llm._words import Words, chunks, grams, lean, minimisers, mix, runs

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of suffixes that a task takes.
TASK_BYTES = 64 << 20


class Suffixes:
    """The sampled suffixes of a chunk: at: word positions; low, high: first and last start of a window anchored there."""

    def __init__(self, w: Words, window: int, anchor: int):
        self.w, self.window, self.left = w, window, window - anchor
        self.prefix = grams(w.hash, anchor)
        starts = np.flatnonzero(w.full(window))
        at = minimisers(self.prefix, self.left + 1)[starts] if len(starts) else starts
        # The anchor never moves back from one window to the next, so a suffix's windows stand in a row; a text's first window starts a row.
        text = np.searchsorted(w.first, starts, side="right")
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        self.at, self.low = at[first], starts[first]
        self.high = starts[np.append(first[1:], len(starts)) - 1] if len(starts) else starts

    def take(self, which: np.ndarray) -> None:
        self.at, self.low, self.high = self.at[which], self.low[which], self.high[which]

    def single(self) -> None:
        """A suffix for each window, with no words but the window's."""
        n = self.high - self.low + 1
        start = np.repeat(self.low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.at, self.low, self.high = np.repeat(self.at, n), start, start

    def records(self) -> np.ndarray:
        """32-bit hashes of the words around each suffix's start, window - anchor before it and window from it; 0 outside its windows."""
        place = self.at[:, None] + np.arange(-self.left, self.window)
        inside = (place >= self.low[:, None]) & (place < self.high[:, None] + self.window)
        word = np.maximum((self.w.hash >> np.uint64(32)).astype(np.uint32), 1)
        return np.where(inside, word[np.where(inside, place, 0)], np.uint32(0))


class Bloom:
    """Bits for 64-bit hashes, four a hash, by double hashing."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        a, b = h % np.uint64(self.bits), mix(h) | np.uint64(1)
        for i in range(4):
            yield ((a + np.uint64(i) * (b >> np.uint64(20))) % np.uint64(self.bits)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for p in self._places(h):
            np.bitwise_or.at(self.data, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self._places(h):
            out &= (self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def _prefixes(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """h, n: how many suffixes of the corpus have each prefix."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s = Suffixes(Words(b.column("text")), window, anchor)
            h, n = np.unique(s.prefix[s.at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return rows.select("text").mapInArrow(lean(scan), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def _bloom_of(prefixes: DataFrame, n: int, most: int) -> np.ndarray:
    """A filter over `n` prefixes, of `most` bits at most: each task makes one of the same size, and they are merged in a tree of tasks."""
    bits = 1 << 20
    while bits < min(12 * n, most):
        bits <<= 1
    if not n:
        return np.zeros(bits // 8, np.uint8)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Bloom(bits)
        for b in batches:
            f.add(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        for i in range(0, len(f.data), 1 << 16):
            part = f.data[i : i + (1 << 16)]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for at, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                parts[at] = parts[at] | x if at in parts else x
        for at, x in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["at", "bits"])

    spark = prefixes.sparkSession
    kind = "at bigint, bits binary"
    merged = prefixes.select("h").coalesce(slots(spark)).mapInArrow(lean(build), kind).repartition(min(slots(spark), bits >> 19), "at").mapInArrow(lean(merge), kind)
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["at"] : r["at"] + len(part)] |= part
    return out


def repeats(record: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, words before the suffix's start) of each window that another record holds too; record: as from Suffixes.records."""
    n, window = len(record), record.shape[1] - left
    # Big-endian bytes sort as the words do; the sorted order and the common words of neighbours are the tree.
    key = np.ascontiguousarray(record[:, left:].astype(">u4")).view(f"S{4 * window}").ravel()
    order = np.argsort(key, kind="stable")
    record = record[order]
    common = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 15):
        z = min(n, a + (1 << 15))
        common[a:z] = np.logical_and.accumulate(record[a:z, left:] == record[a - 1 : z - 1, left:], axis=1).sum(axis=1)
    before = (record[:, :left] > 0).sum(axis=1)  # the most words before, and the fewest, that its windows have
    fewest = window - (record[:, left:] > 0).sum(axis=1)
    found, words = [], []
    side = np.zeros(n, np.uint64)
    for a in range(left + 1):
        if a:
            side = mix(side * _ODD + record[:, left - a].astype(np.uint64))
        node = np.cumsum(common < window - a)  # the node of this depth
        some = np.flatnonzero((fewest <= a) & (a <= before) & (np.bincount(node)[node] > 1))
        if len(some) > 1:
            both = mix(node[some].astype(np.uint64) * _ODD ^ side[some])
            by = np.argsort(both)
            i, j = some[by[:-1]], some[by[1:]]
            same = (node[i] == node[j]) & (side[i] == side[j])
            hit = np.zeros(len(some), bool)
            hit[:-1] |= same
            hit[1:] |= same
            got = order[some[by[hit]]]
            found.append(got)
            words.append(np.full(len(got), a))
    return (np.concatenate(found), np.concatenate(words)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_DEALT = "kind tinyint, key bigint, suffixes binary, refs binary"
_FOUND = "bucket bigint, found binary"


def _dealt(kind: int, key: list[int], suffixes: list[bytes], refs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(key), pa.int8()), pa.array(key, pa.int64()), pa.array(suffixes, pa.binary()), pa.array(refs, pa.binary())], names=["kind", "key", "suffixes", "refs"])


def _by(number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, places that hold it)."""
    order = np.argsort(number, kind="stable")
    for a, e in zip(*(x.tolist() for x in runs(number[order])), strict=True):
        yield int(number[order[a]]), order[a:e]


def _bucket(spans: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(spans[:, 0].view(np.uint64) ^ mix(spans[:, 1].view(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def repeated_ranges(rows: DataFrame, window: int = 35, anchor: int = 16, filter_bits: int = 1 << 27, group: int = 1 << 17) -> DataFrame:
    """doc_id, h, spans: per document with repeated windows, [start, end) word ranges, as one array of longs, sorted.

    rows: doc_id, h (not null: together they name a text), text. anchor: words of a prefix. filter_bits: size of the Bloom filters, at
    most (16 MB), made smaller for few prefixes. group: suffixes that may share a prefix before it is lengthened.
    """
    spark, left = rows.sparkSession, window - anchor
    prefixes = staged(_prefixes(rows, window, anchor).filter("n >= 2"))
    n, total, n_heavy = prefixes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > group, 1))).first()
    sent = spark.sparkContext.broadcast((_bloom_of(prefixes, n, filter_bits), _bloom_of(prefixes.filter(F.col("n") > group), n_heavy, filter_bits)))
    parts = max(slots(spark), total * (4 * (left + window) + 24) // TASK_BYTES)
    groups = 3 * parts

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: spans already known as repeated; kind 1: suffixes for a group of prefixes, with doc_id, h and start (-1: no answer needed)."""
        again, heavy = (Bloom(len(x) * 8, x) for x in sent.value)
        for b in chunks(batches):
            w = Words(b.column("text"))
            ids = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "h")])
            s = Suffixes(w, window, anchor)
            s.take(again.has(s.prefix[s.at]))
            hot = heavy.has(s.prefix[s.at])
            whole = grams(w.hash, window) if hot.any() else None
            for some, lengthened in ((~hot, False), (hot, True)):
                if not some.any():
                    continue
                t = Suffixes.__new__(Suffixes)
                t.__dict__.update(s.__dict__)
                t.take(some)
                if lengthened:
                    t.single()
                record = t.records()
                code = mix((record.astype(np.uint64) * (_ODD ** np.arange(1, record.shape[1] + 1, dtype=np.uint64))).sum(axis=1))
                order = np.argsort(code, kind="stable")
                new = np.ones(len(order), bool)
                new[1:] = (record[order[1:]] != record[order[:-1]]).any(axis=1)
                lead = np.flatnonzero(new)
                size = np.diff(np.append(lead, len(order)))
                text = np.searchsorted(w.first, t.at, side="right") - 1
                base = w.first[text]
                copies = np.sort(order[np.repeat(size > 1, size)])
                if len(copies):
                    span = merged(np.column_stack([ids[text[copies]], (t.low - base)[copies], (t.high - base)[copies] + window]))
                    k, places = zip(*_by(_bucket(span, groups)), strict=True)
                    yield _dealt(0, list(k), [b""] * len(k), [span[x].tobytes() for x in places])
                one = order[lead]
                start = np.where(size > 1, -1, (t.at - base)[one])
                key = mix(whole[t.low[one]]) if lengthened else mix(s.prefix[t.at[one]])
                k, places = zip(*_by((key % np.uint64(groups)).astype(np.int64)), strict=True)
                refs = np.column_stack([ids[text[one]], start])
                yield _dealt(1, list(k), [record[one[x]].tobytes() for x in places], [refs[x].tobytes() for x in places])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers: (doc_id, h, start, end) of covered ranges, in one blob for each bucket of documents."""
        blobs: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for kind, key, blob, ref in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if kind:
                    blobs.setdefault(key, []).append((blob, ref))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ref], pa.binary())], names=["bucket", "found"])
        answers = []
        for key in list(blobs):
            record, ref = (np.frombuffer(b"".join(x), kind).reshape(-1, width) for x, kind, width in zip(zip(*blobs.pop(key), strict=True), (np.uint32, np.int64), (left + window, 3), strict=True))
            which, before = repeats(record, left)
            asked = ref[which, 2] >= 0
            hit, start = ref[which[asked]], ref[which[asked], 2] - before[asked]
            answers.append(merged(np.column_stack([hit[:, :2], start, start + window])))
        if answers:
            found = merged(np.concatenate(answers))
            if len(found):
                k, places = zip(*_by(_bucket(found, groups)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([found[x].tobytes() for x in places], pa.binary())], names=["bucket", "found"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [np.frombuffer(x, np.int64).reshape(-1, 4) for b in batches for x in b.column(1).to_pylist()]
        if blobs:
            span = merged(np.concatenate(blobs))
            lead = np.flatnonzero(np.append(True, (span[1:, :2] != span[:-1, :2]).any(axis=1)))
            off = np.append(lead, len(span)) * 2
            spans = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(span[:, 2:].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(span[lead, 0]), pa.array(span[lead, 1]), spans], names=["doc_id", "h", "spans"])

    dealt = rows.mapInArrow(lean(suffixes), _DEALT)
    answered = dealt.repartition(parts, "kind", "key").mapInArrow(lean(trees), _FOUND)
    return answered.repartition(parts, "bucket").mapInArrow(lean(collect), "doc_id bigint, h bigint, spans array<bigint>")


def merged(spans: np.ndarray) -> np.ndarray:
    """Ranges (doc_id, h, start, end), sorted, those of a document that meet joined."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    other = np.append(True, (spans[1:, :2] != spans[:-1, :2]).any(axis=1))
    # The furthest end so far within a document: ends are lifted by a multiple of the document's number, so one running maximum does.
    lift = np.cumsum(other) * (int(spans[:, 3].max()) + 1)
    far = np.maximum.accumulate(spans[:, 3] + lift) - lift
    first = np.flatnonzero(other | np.append(True, spans[1:, 2] > far[:-1]))
    return np.column_stack([spans[first, :3], far[np.append(first[1:], len(spans)) - 1]])


def remove_repeats(docs: DataFrame, window: int = 35, **options) -> DataFrame:
    """doc_id, text (the kept words joined by one space), n_words, n_removed, kept_sha256 of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("bigint").alias("own"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    spans = repeated_ranges(named.drop("own"), window, **options)
    joined = named.join(spans, ["doc_id", "h"], "left").select("own", "text", "spans")
    return joined.mapInArrow(lean(_cut), "doc_id bigint, text string, n_words bigint, n_removed bigint, kept_sha256 string")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        out = []
        for d, text, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            words = text.encode().split()
            kept = words
            if spans:
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, np.array(spans[0::2]), 1)
                np.add.at(gone, np.array(spans[1::2]), -1)
                kept = [x for x, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
            joined = b" ".join(kept)
            out.append((d, joined.decode(), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()))
        d, t, n, m, s = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(s)], names=["doc_id", "text", "n_words", "n_removed", "kept_sha256"])
