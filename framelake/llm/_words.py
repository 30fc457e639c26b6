"""Vectorised word handling over Arrow text: boundaries, 64-bit word and n-gram hashes, word lookups.

A batch of texts is one byte buffer; everything here works on that buffer with numpy, so the cost is
a few nanoseconds a byte and no Python object is made for a word unless it is new to a worker.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles; temporaries take about 30 times as much.
CHUNK_BYTES = 1 << 20
#: Bytes that a worker's lexicon holds before it is emptied.
LEXICON_BYTES = 40 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes inside a word: all but ASCII white space.
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[[9, 10, 11, 12, 13, 32]] = False
#: Bytes inside a word of letters and digits (all bytes above 127 count as letters); after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Free memory of finished work goes back to the system: workers stay for later tasks, and their allocators would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """scan, for mapInArrow, whose worker keeps no memory of it when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        give_back()

    return run


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `limit` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.binary_length(b.column(b.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < b.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
            stop = max(stop, at + 1)
            yield b.slice(at, stop - at)
            at = stop
        del b, size, ends
        give_back()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """The words of a chunk of texts.

    starts, ends: byte ranges of the words; first: the words of text i are first[i] to first[i + 1];
    hash: a 64-bit hash of each word's bytes.
    """

    def __init__(self, texts: pa.Array, inside: np.ndarray = BLANK_SPLIT, lower: bool = False, hashes: bool = True):
        self.data, self.offsets = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        is_in = inside[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begin = is_in.copy()
        begin[1:] &= ~is_in[:-1] | edge[1:-1]
        stop = is_in.copy()
        stop[:-1] &= ~is_in[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.n = len(self.starts)
        self.hash = self._hash() if hashes else None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def _hash(self, block: int = 1 << 17) -> np.ndarray:
        out = np.empty(self.n, np.uint64)
        longest = int((self.ends - self.starts).max(initial=0))
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(longest - 1, 0), _STEP, np.uint64)]))
        for a in range(0, self.n, block):
            s, e = self.starts[a : a + block], self.ends[a : a + block]
            length = e - s
            at = np.cumsum(length) - length
            inner = np.arange(int(length.sum())) - np.repeat(at, length)
            value = _BYTE[self.data[np.repeat(s, length) + inner]] * power[inner]
            out[a : a + block] = mix(np.add.reduceat(value, at) + length.astype(np.uint64))
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def word_list(self, which: np.ndarray) -> list[bytes]:
        whole, s, e = self.data.tobytes(), self.starts[which].tolist(), self.ends[which].tolist()
        return [whole[a:b] for a, b in zip(s, e, strict=True)]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def full(self, k: int) -> np.ndarray:
        """Which word positions start k words that lie in one text."""
        return np.arange(self.n) + k <= np.repeat(self.first[1:], self.counts)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of h[i:i + k] for each i; positions too near the end hold no meaning.

    Built by doubling, so k words cost about 2 log2(k) passes.
    """
    n = len(h)
    out, done, part, size, rest = np.zeros(n, np.uint64), 0, h.copy(), 1, k
    power = _GRAM
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                shift = np.zeros(n, np.uint64)
                if done < n:
                    shift[: n - done] = part[done:]
                out = out + shift * np.uint64(pow(int(_GRAM), done, 1 << 64))
                done += size
            rest >>= 1
            if rest:
                nxt = np.zeros(n, np.uint64)
                if size < n:
                    nxt[: n - size] = part[size:]
                part = part + nxt * power
                power = np.uint64(pow(int(power), 2, 1 << 64))
                size *= 2
    return mix(out + np.uint64(k))


def minimisers(h: np.ndarray, span: int) -> np.ndarray:
    """For each i, the position of the least of h[i:i + span], the first on ties; by doubling."""
    n = len(h)
    if n < span:
        return np.zeros(0, np.int64)
    best, at, size = h.copy(), np.arange(n), 1
    while size < span:
        step = min(size, span - size)
        m = n - step
        less = best[step:] < best[:m]
        best[:m] = np.where(less, best[step:], best[:m])
        at[:m] = np.where(less, at[step:], at[:m])
        size += step
    return at[: n - span + 1]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each value, position of each code's first occurrence), by hashing rather than sorting."""
    d = pa.array(h).dictionary_encode()
    code = d.indices.to_numpy(zero_copy_only=False)
    first = np.empty(len(d.dictionary), np.int64)
    first[code[::-1]] = np.arange(len(h) - 1, -1, -1)
    return code, first


def sum_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's run of positions; 0 for an empty run."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[first[1:]] - total[first[:-1]]


class Lexicon:
    """What a worker has found out about words so far: word hash -> a row of `values`.

    A word is computed when first met. The store is emptied once it takes `limit` bytes, so its
    memory is bounded whatever the corpus holds; results never depend on it.
    """

    def __init__(self, compute: Callable[[list[bytes]], list[np.ndarray]], limit: int = LEXICON_BYTES):
        self.compute, self.limit = compute, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.parts: list[np.ndarray] | None = None
        self.count = 0

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.rows.nbytes + sum(p.nbytes for p in self.parts or [])

    def lookup(self, words: Words) -> tuple[np.ndarray, list[np.ndarray]]:
        """(row of each word of the chunk, columns by row)."""
        code, first = distinct(words.hash)
        row, parts = self.rows_of(words, first)
        return row[code], parts

    def rows_of(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(row of each of these words, all different; columns by row)."""
        if self.nbytes > self.limit:
            self._clear()
        unique = words.hash[which]
        at = np.searchsorted(self.keys, unique)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == unique[known]
        row = np.empty(len(unique), np.int32)
        row[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new) or self.parts is None:
            got = self.compute(words.word_list(which[new]))
            row[new] = self.count + np.arange(len(new))
            self.parts = got if self.parts is None else self.merge(self.parts, got)
            self.count += len(new)
            new = new[np.argsort(unique[new])]
            at = np.searchsorted(self.keys, unique[new])
            self.keys, self.rows = np.insert(self.keys, at, unique[new]), np.insert(self.rows, at, row[new])
        return row, self.parts

    def merge(self, a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [np.concatenate([x, y]) for x, y in zip(a, b, strict=True)]


class RaggedLexicon(Lexicon):
    """A lexicon whose compute() returns [lengths, flat values]; stored as [starts, lengths, flat]."""

    def merge(self, a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [np.concatenate([a[0], b[0] + len(a[2])]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])]

    def spread(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(flat values of all words in order, number of values of each word)."""
        row, (starts, lengths, flat) = self.lookup(words)
        length = lengths[row]
        at = np.cumsum(length) - length
        return flat[np.repeat(starts[row] - at, length) + np.arange(int(length.sum()))], length


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return start, np.append(start[1:], len(values))
