"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics are counted from a chunk's bytes and word hashes. Trees are complete and of one depth, their
features, thresholds and leaf values flattened into arrays, so a batch of documents walks all trees with
a few numpy gathers a level. They are fitted on the driver, on a bounded sample of labelled rows
(`sample`: the least by a hash of the id).

Rows: a null text counts as empty; every row gets a score. Labels: null ones are left out, several for one
doc_id count as their least. Without labelled rows all scores are 0.5; with labels of one kind only, that
kind's smoothed share. Repeated rows are answered each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._stage import fold
from framelake.llm._words import Words, chunks, distinct, grams, lean, mix, sum_by_text

# Classes of bytes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 newline, 5 full stop and comma, 6 ! and ?,
# 7 symbols, 8 quotes and brackets, 9 other ASCII, 10 control, 11 beyond ASCII.
_CLASS = np.full(256, 9, np.int64)
_CLASS[:32] = 10
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 11
for _k, _chars in ((3, b" \t\r\x0b\x0c"), (4, b"\n"), (5, b".,;:"), (6, b"!?"), (7, b"#*$%&|<>@/\\=+~^_"), (8, b"'\"()[]{}")):
    _CLASS[list(_chars)] = _k
_CLASSES = 12


def features(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text."""
    w = Words(texts)
    n = len(texts)
    size = np.diff(w.offsets)
    text_of_byte = np.repeat(np.arange(n), size)
    by_class = np.bincount(text_of_byte * _CLASSES + _CLASS[w.data], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    words = w.counts.astype(float)
    length = (w.ends - w.starts).astype(float)
    text = w.text_of_word()
    salt = mix(text.astype(np.uint64) + np.uint64(1))
    per = lambda x, of: x / np.maximum(of, 1)

    _, first = distinct(w.hash ^ salt)
    new_words = per(np.bincount(text[first], minlength=n), words)
    ok = w.full(3)
    _, first = distinct(grams(w.hash, 3)[ok] ^ salt[ok])
    new_threes = per(np.bincount(text[ok][first], minlength=n), np.maximum(words - 2, 0))
    # Lines, as words of a split at newlines.
    lines = Words(texts, _NOT_NEWLINE)
    line_text = lines.text_of_word()
    _, first = distinct(lines.hash ^ mix(line_text.astype(np.uint64) + np.uint64(1)))
    n_lines = lines.counts.astype(float)
    new_lines = per(np.bincount(line_text[first], minlength=n), n_lines)
    mean = per(sum_by_text(length, w.first), words)
    spread = np.sqrt(np.maximum(per(sum_by_text(length**2, w.first), words) - mean**2, 0))
    short = per(sum_by_text((length <= 3).astype(float), w.first), words)
    long = per(sum_by_text((length >= 15).astype(float), w.first), words)
    last = w.data[w.ends - 1] if w.n else np.zeros(0, np.uint8)
    ends_symbol = per(sum_by_text((_CLASS[last] >= 6).astype(float) * (_CLASS[last] <= 7), w.first), words)
    return np.column_stack([np.log1p(size), np.log1p(words), mean, spread, short, long, new_words, new_threes, new_lines, np.log1p(n_lines), per(words, n_lines), ends_symbol, by_class / np.maximum(size, 1)[:, None]])


_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


@dataclass
class Trees:
    """feature, threshold: (tree, inner node); value: (tree, leaf); node k has children 2k + 1 and 2k + 2."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = (1 << self.depth) - 1
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, l2: float = 2.0) -> Trees:
    share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    empty = Trees(base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) < 20 or y.min() == y.max():
        return empty
    width = x.shape[1]
    edges = []
    for f in range(width):  # half way between values that occur
        v = np.unique(x[:, f])
        i = np.unique(np.searchsorted(v, np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1]), side="right"))
        i = i[(i > 0) & (i < len(v))]
        edges.append((v[i - 1] + v[i]) / 2)
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    column = np.arange(width) * bins
    margin = np.full(len(y), base)
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins)
        threshold = np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * (width * bins) + column + binned).ravel()
            gs = np.bincount(key, np.repeat(g, width), many * width * bins).reshape(many, width, bins)
            hs = np.bincount(key, np.repeat(h, width), many * width * bins).reshape(many, width, bins)
            gl, hl = np.cumsum(gs, axis=2), np.cumsum(hs, axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            flat = gain.reshape(many, -1)
            best = flat.argmax(axis=1)
            for k in range(many):
                if flat[k, best[k]] > 1e-6:
                    f, c = divmod(int(best[k]), bins)
                    feature[first + k], cut[first + k] = f, c
                    threshold[first + k] = edges[f][c] if c < len(edges[f]) else np.inf
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin += value[leaf]
        all_f.append(feature)
        all_t.append(threshold)
        all_v.append(value)
    return Trees(base, depth, np.array(all_f), np.array(all_t), np.array(all_v))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Trees:
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold("doc_id", 5) != 0))
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(list(features(b.column("text"))), pa.list_(pa.float64()))], names=["quality", "x"])

    got = rows.mapInArrow(lean(scan), "quality int, x array<double>").collect()
    x = np.array([r["x"] for r in got]) if got else np.zeros((0, 1))
    return boost(x, np.array([r["quality"] for r in got], float))


def score(docs: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s = sent.value.score(features(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(scan), "doc_id bigint, score double, predicted int")
