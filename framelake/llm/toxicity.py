"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A document's features are the character n-grams (3 to 6, with marks at both ends) of its words, each present or not, hashed to
2^20 buckets. Over the labelled training rows every bucket's documents are counted by label; r, the log of the ratio of its
smoothed shares, scales the feature, and a logistic regression is fitted on the scaled features (L-BFGS; both labels weigh the same). Only the `most`
buckets with the largest |r| sqrt(documents), of two documents at least, take part. Training takes at most `sample` labelled rows, the least by a hash of
the id: their counts are summed by Spark, and what reaches the driver is `most` counts and the sample's rows as lists of those.

Scoring never forms a document's n-grams twice for a word: a worker keeps what it found out about words, within bounds; all words of
a text count, so its length has no limit.

Rows: a null text counts as empty; a text without words has the model's bias alone. Labels: null ones are left out; several for one doc_id count as
toxic if any says so. Without labelled rows all scores are 0.5; with labels of one kind only, that kind's smoothed
share. Repeated rows are answered each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._stage import fold, staged
from framelake.llm._words import ALNUM, RaggedLexicon, Words, chunks, distinct, lean, mix

ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_grams(words: list[bytes], keep: np.ndarray | None = None) -> list[np.ndarray]:
    """[starts, lengths, flat]: each word's n-grams as buckets; keep: bucket -> feature, below 0 left out. Words are UTF-8."""
    text = np.frombuffer(b"".join(b"<" + w + b">" for w in words).decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    last = np.flatnonzero(text == 62)  # a word has no > of its own
    word = np.searchsorted(last, np.arange(len(text)))
    flat, owner = [], []
    h = mix(text + np.uint64(7))
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * _STEP + text[n - 1 :] if len(h) > 1 else h[:0]
        if n in ORDERS:
            at = np.flatnonzero(word[: len(h)] == word[n - 1 : n - 1 + len(h)])
            flat.append((mix(h[at] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
            owner.append(word[at])
    flat, owner = np.concatenate(flat), np.concatenate(owner)
    if keep is not None:
        flat = keep[flat]
        owner, flat = owner[flat >= 0], flat[flat >= 0]
    order = np.argsort(owner, kind="stable")
    lengths = np.bincount(owner, minlength=len(words))
    return [np.cumsum(lengths) - lengths, lengths, flat[order]]


class GramLexicon(RaggedLexicon):
    def __init__(self, keep: np.ndarray | None = None):
        super().__init__(lambda words: word_grams(words, keep))


def features(texts: pa.Array, lexicon: GramLexicon) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each feature that a text has, once each."""
    w = Words(texts, ALNUM, lower=True)
    if not w.n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = w.text_of_word()
    _, first = distinct(w.hash ^ mix(text.astype(np.uint64) + np.uint64(1)))
    row, (starts, lengths, flat) = lexicon.lookup(w)
    row = row[first]
    length = lengths[row]
    at = np.cumsum(length) - length
    found = flat[np.repeat(starts[row] - at, length) + np.arange(int(length.sum()))].astype(np.int64)
    key = np.repeat(text[first], length) * BUCKETS + found
    _, first = distinct(key.view(np.uint64))
    return key[first] // BUCKETS, key[first] % BUCKETS


@dataclass
class Linear:
    """keep: bucket -> feature, below 0 if it has none; weight: of each feature, the log-count ratio already in it."""

    bias: float
    keep: np.ndarray
    weight: np.ndarray

    def score(self, texts: pa.Array, lexicon: GramLexicon) -> np.ndarray:
        text, feature = features(texts, lexicon)
        margin = self.bias + np.bincount(text, self.weight[feature], len(texts)) if len(text) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def regress(row: np.ndarray, feature: np.ndarray, y: np.ndarray, scale: np.ndarray, l2: float = 0.02, rounds: int = 80, memory: int = 8) -> tuple[float, np.ndarray]:
    """Logistic regression by L-BFGS on features of value scale[feature], with the same weight for both labels: (bias, weight with the scale in it)."""
    n, k = len(y), len(scale)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(n - y.sum(), 1))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = w[k] + np.bincount(row, (scale * w[:k])[feature], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        off = (p - y) * share
        g = np.append(scale * np.bincount(feature, off[row], k) + l2 * w[:k], off.sum())
        return float(((np.logaddexp(0, z) - y * z) * share).sum() + l2 / 2 * (w[:k] ** 2).sum()), g

    w = np.zeros(k + 1)
    at, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, coefficients = g.copy(), []
        for s, u in reversed(past):
            a = (s @ d) / (s @ u)
            coefficients.append(a)
            d -= a * u
        if past:
            s, u = past[-1]
            d *= (s @ u) / (u @ u)
        for (s, u), a in zip(past, reversed(coefficients), strict=True):
            d += s * (a - (u @ d) / (s @ u))
        step, slope = (1.0 if past else 1 / max(1e-12, np.abs(g).max())), float(g @ d)
        while True:
            new, (value, grad) = w - step * d, loss(w - step * d)
            if value <= at - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if at - value < 1e-9:
            break
        if (grad - g) @ (new - w) > 1e-12:
            past = [*past, (new - w, grad - g)][-memory:]
        w, at, g = new, value, grad
    return float(w[k]), scale * w[:k]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most: int = 8_192, smooth: float = 0.1) -> Linear:
    """From labelled rows whose crc32(doc_id) mod 3 is not 1."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", 3) != 1))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    taught = staged(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    kinds = {r["toxic"] > 0: r["count"] for r in taught.groupBy("toxic").count().collect()}
    toxic, clean = kinds.get(True, 0), kinds.get(False, 0)
    nothing = Linear(float(np.log((toxic + 1) / (clean + 1))), np.full(BUCKETS, -1, np.int32), np.zeros(0))
    if not toxic or not clean:
        return nothing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = GramLexicon(), np.zeros((2, BUCKETS), np.int64)
        for b in chunks(batches):
            text, bucket = features(b.column("text"), lexicon)
            bad = (b.column("toxic").to_numpy() > 0)[text]
            seen[1] += np.bincount(bucket[bad], minlength=BUCKETS)
            seen[0] += np.bincount(bucket[~bad], minlength=BUCKETS)
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[1, some]), pa.array(seen[0, some])], names=["bucket", "p", "q"])

    counts = staged(taught.mapInArrow(lean(count), "bucket int, p bigint, q bigint").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")))
    total = counts.agg(*[(F.sum(c) + smooth * BUCKETS).alias(c) for c in ("p", "q")]).first()
    ratio = F.log((F.col("p") + smooth) / F.lit(total["p"])) - F.log((F.col("q") + smooth) / F.lit(total["q"]))
    signal = F.abs(ratio) * F.sqrt(F.col("p") + F.col("q"))
    best = counts.filter("p + q > 1").select("bucket", ratio.alias("r"), signal.alias("signal")).orderBy(F.desc("signal"), "bucket").limit(most).collect()
    keep = np.full(BUCKETS, -1, np.int32)
    keep[[r["bucket"] for r in best]] = np.arange(len(best))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = GramLexicon(keep)
        for b in chunks(batches):
            text, feature = features(b.column("text"), lexicon)
            order = np.argsort(text, kind="stable")
            cut = np.searchsorted(text[order], np.arange(b.num_rows + 1))
            own = [feature[order[i:j]].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(own, pa.binary())], names=["toxic", "x"])

    got = taught.mapInArrow(lean(rows), "toxic int, x binary").collect()
    x = [np.frombuffer(r["x"], np.int32) for r in got]
    bias, weight = regress(np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x), np.array([r["toxic"] > 0 for r in got], float), np.array([r["r"] for r in best]))
    return Linear(bias, keep, weight)


def score(docs: DataFrame, model: Linear, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (1: toxic), predicted of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = GramLexicon(sent.value.keep)
        for b in chunks(batches):
            s = sent.value.score(b.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(scan), "doc_id bigint, score double, predicted int")
