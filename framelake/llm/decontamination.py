"""Benchmark decontamination by a prefix-filtered containment join.

Each benchmark item is cut into windows of `window` words in a row (an item with fewer words is one
window). A document holds a window if the window's words occur in it in a row. As all of a window's
words must occur, its rarest word alone is the necessary prefix: words are ordered by how often the
documents hold them, a document's words are looked up among the prefixes, the word's place inside the
window gives the one place where the window can start (positional bound), which must leave room in
the text for the window's length (length bound); the window there is found by its hash and compared word by word.

The benchmark is dealt into blocks of at most `block_words` words. Each block goes to every task
(about 60 MB at the default), and documents are read once for each block; the usual
benchmark is one block.

Rows: null texts have no words. Repeated items (same item_id) count once, items with a null item_id are left
out. Repeated documents are answered each. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._stage import staged
from framelake.llm._words import ALNUM, Words, chunks, grams, lean, minimisers, mix, runs


class Index:
    """Windows of benchmark items, by their rarest word, all in flat arrays: about 60 bytes a word of the items.

    flat: the items' words' hashes in a row. Of each distinct window, by size and key: at: where it starts in flat; place: of its prefix
    word; item_first, item: numbers of the items that hold it. word, may: prefix words' hashes, sorted, and a bit for each place that they have.
    """

    def __init__(self, texts: list[str], ids: list[str], window: int, known: np.ndarray, counts: np.ndarray):
        w = Words(pa.array(texts, pa.string()), ALNUM, lower=True)
        self.names, self.flat = np.unique(np.array(ids, str), return_inverse=True)[0] if ids else np.zeros(0, str), w.hash
        number = np.searchsorted(self.names, np.array(ids, str)) if ids else np.zeros(0, np.int64)
        # Rarity as one number: by count in the documents, then by hash.
        rank = np.empty(len(known), np.uint64)
        rank[np.lexsort((known, counts))] = np.arange(len(known), dtype=np.uint64)
        rarity = rank[np.searchsorted(known, w.hash)] if w.n else np.zeros(0, np.uint64)
        self.sizes: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        word, may = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for size in range(1, window + 1):
            starts = np.flatnonzero(w.full(size) & ((np.repeat(w.counts, w.counts) == size) if size < window else True))
            if not len(starts):
                continue
            place = (minimisers(rarity, size) - np.arange(max(0, w.n - size + 1)))[starts]
            one, two = grams(w.hash, size)[starts], grams(mix(w.hash), size)[starts]
            text = np.searchsorted(w.first, starts, side="right") - 1
            order = np.lexsort((number[text], two, one))
            new = np.ones(len(order), bool)
            new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
            first = np.flatnonzero(new)
            again = np.zeros(len(order), bool)  # the same item holds the window twice
            again[1:] = ~new[1:] & (number[text[order[1:]]] == number[text[order[:-1]]])
            holder = np.cumsum(new)[~again] - 1
            item_first = np.searchsorted(holder, np.arange(len(first) + 1))
            lead = order[first]
            self.sizes.append((size, one[lead], starts[lead], place[lead], item_first, number[text[order[~again]]]))
            word.append(w.hash[starts[lead] + place[lead]])
            may.append(np.left_shift(1, place[lead]))
        both, bits = np.concatenate(word), np.concatenate(may)
        order = np.argsort(both, kind="stable")
        lead, _ = runs(both[order])
        self.word = both[order[lead]]
        self.may = np.bitwise_or.reduceat(bits[order], lead) if len(lead) else bits

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(start, size, text) of every occurrence of a window in a chunk of texts, and for each text the numbers of the items it holds.

        A prefix word asks for one window at each of its places: what it costs grows neither with the windows that share the word nor
        with how often these occur together.
        """
        found: list[tuple[np.ndarray, ...]] = []
        if len(self.word) and w.n:
            at = np.searchsorted(self.word, w.hash)
            at[at == len(self.word)] = 0
            pos = np.flatnonzero(self.word[at] == w.hash)
            may, text = self.may[at[pos]], np.searchsorted(w.first, pos, side="right") - 1
            for size, key, begin, place, item_first, item in self.sizes:
                whole = grams(w.hash, size)
                for j in range(size):
                    start = pos - j
                    ok = (may >> j & 1 == 1) & (start >= w.first[text]) & (start + size <= w.first[text + 1])
                    start, of = start[ok], text[ok]
                    window = np.searchsorted(key, whole[start])
                    window[window == len(key)] = 0
                    same = (key[window] == whole[start]) & (place[window] == j)
                    for k in range(size):  # the exact check, a word of all candidates at a time
                        same[same] = w.hash[start[same] + k] == self.flat[begin[window[same]] + k]
                    start, of, window = start[same], of[same], window[same]
                    many = item_first[window + 1] - item_first[window]
                    ends = np.cumsum(many)
                    items = item[np.repeat(item_first[window] - (ends - many), many) + np.arange(int(many.sum()))]
                    pairs = np.unique(np.column_stack([np.repeat(of, many), items]), axis=0)
                    found.append((start, np.full(len(start), size), of, pairs))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, [none] * (len(w.first) - 1)
        start, size, text = (np.concatenate([f[k] for f in found]) for k in range(3))
        pairs = np.unique(np.concatenate([f[3] for f in found]), axis=0)
        cut = np.searchsorted(pairs[:, 0], np.arange(len(w.first)))
        return start, size, text, [pairs[a:b, 1] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _word_counts(rows: DataFrame, known: np.ndarray) -> np.ndarray:
    """How often the documents hold each of the known words (bounded by the block)."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for b in chunks(batches):
            h = Words(b.column("text"), ALNUM, lower=True).hash
            at = np.searchsorted(sent.value, h)
            at[at == len(sent.value)] = 0
            total += np.bincount(at[sent.value[at] == h], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(sent.value[some].view(np.int64)), pa.array(total[some])], names=["h", "n"])

    got = rows.select("text").mapInArrow(lean(count), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    got = got.toArrow()
    out = np.zeros(len(known), np.int64)
    out[np.searchsorted(known, got.column("h").to_numpy().view(np.uint64))] = got.column("n").to_numpy()
    return out


def _blocks(bench: DataFrame, block_words: int) -> Iterator[list]:
    block, size = [], 0
    for r in bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").toLocalIterator():
        n = len(r["text"]) // 2 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append(r)
        size += n
    if block:
        yield block


def find_contamination(docs: DataFrame, bench: DataFrame, window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans of each document.

    items: the item ids found, sorted; spans: [start, end) word ranges that are hit, merged.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"items": F.lit(None).cast("array<string>"), "spans": F.lit(None).cast("array<bigint>")})
    blocks = _blocks(bench, block_words)
    block = next(blocks, [])
    while True:
        index = _index(rows, block, window)
        block = next(blocks, None)
        if block is None:
            return rows.mapInArrow(lean(_scan(index, True)), _RESULT)
        rows = staged(rows.mapInArrow(lean(_scan(index, False)), _SO_FAR))


def clean(docs: DataFrame, bench: DataFrame, window: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """The rows of docs, all their columns, that hold no window: each row by its own text, whatever its doc_id."""
    blocks = _blocks(bench, block_words)
    block = next(blocks, [])
    while True:
        docs_left = docs.mapInArrow(lean(_without(_index(docs, block, window))), docs.schema)
        block = next(blocks, None)
        if block is None:
            return docs_left
        docs = staged(docs_left)


def _without(sent):
    """Leaves out the rows that one block's index finds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(b.column(b.schema.get_field_index("text")), ALNUM, lower=True)
            keep = np.ones(b.num_rows, bool)
            keep[sent.value.hits(w)[2]] = False
            yield b.filter(pa.array(keep))

    return scan


def _index(rows: DataFrame, block: list, window: int):
    """The broadcast index of a block's items, by the counts of its words in rows."""
    known = np.unique(Words(pa.array([r["text"] for r in block], pa.string()), ALNUM, lower=True).hash)
    counts = _word_counts(rows, known) if len(known) else np.zeros(0, np.int64)
    return rows.sparkSession.sparkContext.broadcast(Index([r["text"] for r in block], [r["item_id"] for r in block], window, known, counts))


_SO_FAR = "doc_id bigint, text string, items array<string>, spans array<bigint>"
_RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<bigint>"


def _scan(sent, last: bool):
    """Adds one block's items and spans to each document's; after the last block, the result."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in chunks(batches):
            w = Words(b.column("text"), ALNUM, lower=True)
            start, size, _, met = index.hits(w)
            delta = np.zeros(w.n + 1, np.int64)
            np.add.at(delta, start, 1)
            np.add.at(delta, start + size, -1)
            items = [{*(x or ()), *index.names[n].tolist()} for x, n in zip(b.column("items").to_pylist(), met, strict=True)]
            for t, x in enumerate(b.column("spans").to_pylist()):
                for a, e in zip((x or [])[0::2], (x or [])[1::2], strict=True):
                    delta[w.first[t] + a] += 1
                    delta[w.first[t] + e] -= 1
            cover = np.cumsum(delta[:-1]) > 0
            n_hit = np.diff(np.concatenate([[0], np.cumsum(cover)])[w.first])
            spans: list[list[int]] = [[] for _ in items]
            for t in np.flatnonzero(n_hit).tolist():
                spans[t] = np.flatnonzero(np.diff(cover[w.first[t] : w.first[t + 1]], prepend=False, append=False)).tolist()
            named = [sorted(x) for x in items]
            tail = {"items": pa.array(named, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.int64()))}
            if last:
                tail = {
                    "n_words": pa.array(w.counts.astype(np.int64)),
                    "n_hit": pa.array(n_hit.astype(np.int64)),
                    "n_items": pa.array([len(x) for x in named], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()),
                    "contaminated": pa.array(n_hit > 0),
                    **tail,
                }
            else:
                tail = {"text": b.column("text"), **tail}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **tail})

    return scan
