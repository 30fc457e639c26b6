"""Ranked lexical search over blocks of documents, with block-max pruning.

The index has a row for each block, a range of up to 64 documents as they are stored: the block's terms with, for each, the most that it adds to any of the
block's documents (before the query's weight) and the number of those documents, and a forward part, the documents' postings. It is built without a
shuffle, in two passes over the texts: terms are counted first, as a document's length counts relative to the mean.

A search takes queries in batches of bounded size, whose terms go to every task. A view of the index with those terms alone gives document frequencies, and with their weights
each block's bound for each query: no document of the block scores more. Blocks are taken by bound: the 8 best of each query are scored first, then the 64 best
that still reach the score at rank k, which can only rise; the last pass scores, in order of bound, every block whose bound reaches it, until the bounds of those left fall below. Nothing
is left out that could be ranked: a bound that equals the score at rank k is still opened, as ties go to the lesser doc_id.

Scores: a term's weight is floor(1000 ln((2N + 2) / (2df + 1))); with m = 75 + 25nN div L, a document's score sums weight * (10^9 tf div (1000 tf + 12 m)) over the
query's terms, repeats included; N: documents with a term, L: all their terms, n: the document's. All of it is exact in integers; sums go through
doubles where none can pass 2^53, else through 64-bit integers.

Rows: null texts and texts without terms are never ranked, nor queries without any. Rows that share a doc_id are ranked each, equal scores by doc_id, a null one last. A
null item_id is answered as such; each row of the queries is ranked for itself. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import contextlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm._stage import staged
from framelake.llm._words import ALNUM, Words, chunks, distinct, lean

BLOCK_DOCUMENTS, BLOCK_BYTES = 64, 1 << 17
ROUNDS = (8, 64)
#: Rows of the index are wide: so many of them lie in a group of a file, and in a page, whatever a task's share of the texts.
_FILES = {"parquet.block.row.count.limit": 64, "parquet.page.row.count.limit": 16}
_EXACT = 1 << 53
_INDEX = "block bigint, terms array<string>, most array<bigint>, df array<int>, doc_id array<bigint>, m array<bigint>, first array<int>, term array<int>, tf array<int>"


@dataclass
class Index:
    """blocks: the rows; documents and terms: N and L."""

    blocks: DataFrame
    documents: int
    terms: int


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _lists(values: np.ndarray | pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def build(docs: DataFrame, documents: int = BLOCK_DOCUMENTS, size: int = BLOCK_BYTES) -> Index:
    """The index of whole texts, written to the shared folder. documents, size: the most that a block holds of either (one document at least)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in chunks(batches):
            own = Words(b.column("text"), ALNUM, lower=True, hashes=False).counts
            n, total = n + int((own > 0).sum()), total + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    all_docs, all_terms = (x or 0 for x in rows.mapInArrow(lean(count), "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in chunks(batches):
            w = Words(b.column("text"), ALNUM, lower=True)
            if not w.n:
                continue
            ids = b.column("doc_id")
            code, spot = distinct(w.hash)
            words = pa.array(w.word_list(spot), pa.binary()).cast(pa.string())
            n = w.counts.astype(np.int64)
            m = 75 + (25 * n * all_docs) // all_terms
            out: dict[str, list] = {k: [] for k in ("block", "terms", "most", "df", "doc_id", "m", "first", "term", "tf")}
            start = 0
            while start < b.num_rows:
                stop = int(np.searchsorted(w.offsets, w.offsets[start] + size, side="right")) - 1
                stop = min(max(stop, start + 1), start + documents, b.num_rows)
                own = slice(w.first[start], w.first[stop])
                if w.first[stop] > w.first[start]:
                    kinds, local = np.unique(code[own], return_inverse=True)
                    some = np.flatnonzero(n[start:stop])
                    doc = np.repeat(np.arange(len(some)), n[start:stop][some])
                    posting, tf = np.unique(doc * len(kinds) + local, return_counts=True)
                    doc, term = posting // len(kinds), posting % len(kinds)
                    value = part(tf.astype(np.int64), m[start:stop][some][doc])
                    by_term = np.argsort(term, kind="stable")
                    edge = np.searchsorted(term[by_term], np.arange(len(kinds)))
                    out["block"].append(number)
                    out["terms"].append(words.take(pa.array(kinds)))
                    out["most"].append(np.maximum.reduceat(value[by_term], edge))
                    out["df"].append(np.bincount(term, minlength=len(kinds)).astype(np.int32))
                    out["doc_id"].append(ids.take(pa.array(start + some)))
                    out["m"].append(m[start:stop][some])
                    out["first"].append(np.searchsorted(doc, np.arange(len(some) + 1)).astype(np.int32))
                    out["term"].append(term.astype(np.int32))
                    out["tf"].append(tf.astype(np.int32))
                    number += 1
                start = stop
            sizes = {k: [len(x) for x in v] for k, v in out.items() if k != "block"}
            joined = {k: pa.concat_arrays(v) if k in ("terms", "doc_id") else np.concatenate(v) for k, v in out.items() if k != "block"}
            yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int64()), *[_lists(joined[k], sizes[k]) for k in joined]], names=list(out))

    return Index(staged(rows.mapInArrow(lean(scan), _INDEX), **_FILES), all_docs, all_terms)


@contextlib.contextmanager
def few_rows(spark: SparkSession, rows: int = 16):
    """Blocks are wide: so many of them at a time are read from files and go to Python, for what runs inside."""
    keys = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(key) for key in keys]
    for key in keys:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        for key, value in zip(keys, before, strict=True):
            spark.conf.set(key, value)


@dataclass
class Queries:
    """A batch: names: item ids; terms: all distinct terms; (row, column, times): how often query row has term column."""

    names: list[int | None]
    terms: pa.Array
    row: np.ndarray
    column: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(items: list) -> Queries:
        w = Words(pa.array([r["text"] or "" for r in items], pa.string()), ALNUM, lower=True)
        words = w.word_list(np.arange(w.n))
        place: dict[bytes, int] = {}
        for x in words:
            place.setdefault(x, len(place))
        pairs = Counter(zip(w.text_of_word().tolist(), (place[x] for x in words), strict=True))
        r, c = np.array([*pairs], np.int64).reshape(-1, 2).T
        return Queries([r["item_id"] for r in items], pa.array([x.decode("utf-8", "replace") for x in place], pa.string()), r, c, np.array([*pairs.values()], np.int64))

    def weights(self, weight: np.ndarray) -> np.ndarray:
        """(query, term): weight times repeats, as doubles where every sum is exact in them."""
        out = np.zeros((len(self.names), len(self.terms)), np.int64)
        out[self.row, self.column] = self.times * weight[self.column]
        most = max((int(x) for x in out.sum(axis=1)), default=0) * 1_000_000
        return out.astype(np.float64) if most < _EXACT else out


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values of a batch's lists, where each list starts and the last ends)."""
    return column.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _places(b: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(query term of each term of the batch's blocks, -1 for none; where the blocks' terms start)."""
    values, start = _flat(b.column("terms"))
    return pc.index_in(values, terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), start


def _view(blocks: DataFrame, terms) -> DataFrame:
    """block, q, most, df: of each block the query terms that it holds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q, start = _places(b, terms.value)
            some = np.flatnonzero(q >= 0)
            cut = np.searchsorted(some, start)
            most, df = (b.column(c).flatten().to_numpy()[some] for c in ("most", "df"))
            yield pa.RecordBatch.from_arrays([b.column("block"), *[_lists(x, np.diff(cut).tolist()) for x in (q[some].astype(np.int32), most, df)]], names=["block", "q", "most", "df"])

    return staged(blocks.select("block", "terms", "most", "df").mapInArrow(lean(scan), "block bigint, q array<int>, most array<bigint>, df array<int>"))


def _bounds(q: np.ndarray, most: np.ndarray, start: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(block, query): the most that a document of the block can score. Block i has the terms start[i] to start[i + 1]; q below 0 is in no query."""
    out = np.zeros((len(start) - 1, len(weights)), np.int64)
    for i in range(0, len(out), 64):
        j = min(i + 64, len(out))
        at = np.flatnonzero(q[start[i] : start[j]] >= 0) + start[i]
        dense = np.zeros((j - i, weights.shape[1]), weights.dtype)
        dense[np.searchsorted(start[i:j], at, side="right") - 1, q[at]] = most[at]
        out[i:j] = dense @ weights.T
    return out


def _best_blocks(view: DataFrame, sent, least: np.ndarray, many: int) -> DataFrame:
    """The `many` blocks with the greatest bounds for each query, of those that reach the query's least score: (block, items)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            if not b.num_rows:
                continue
            q, start = _flat(b.column("q"))
            bound = _bounds(q.to_numpy(), b.column("most").flatten().to_numpy(), start, weights)
            at, item = np.nonzero(bound >= least)
            held = _top([np.concatenate(x) for x in zip(held, (item, bound[at, item], b.column("block").to_numpy()[at]), strict=True)], many)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["item", "bound", "block"])

    found = view.select("block", "q", "most").mapInArrow(lean(scan), "item bigint, bound bigint, block bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))
    return found.withColumn("place", place).filter(F.col("place") <= many).groupBy("block").agg(F.collect_list(F.col("item").cast("int")).alias("items"))


def _top(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (item, value, id, ...) each item's k rows with the greatest value, then the least id."""
    order = np.lexsort((rows[2], -rows[1], rows[0]))
    item = rows[0][order]
    first = np.searchsorted(item, item, side="left")
    return [x[order[np.arange(len(item)) - first < k]] for x in rows]


def _scored(blocks: DataFrame, terms, sent, least: np.ndarray, k: int) -> DataFrame:
    """item, score, doc_id: each query's k best documents of each task, in blocks (with a column items: for those queries alone), with at least the least score."""
    chosen = "items" in blocks.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, floor = sent.value, least.copy()
        held = [np.zeros(0, np.int64)] * 4  # item, score, id, whether the id is null
        for b in batches:
            if not b.num_rows:
                continue
            q, start = _places(b, terms.value)
            bound = _bounds(q, b.column("most").flatten().to_numpy(), start, weights)
            if chosen:
                wanted = np.zeros(bound.shape, bool)
                items, cut = _flat(b.column("items"))
                wanted[np.repeat(np.arange(b.num_rows), np.diff(cut)), items.to_numpy()] = True
                bound[~wanted] = -1
            ids, docs = _flat(b.column("doc_id"))
            m = b.column("m").flatten().to_numpy()
            term, post = _flat(b.column("term"))
            term, tf = term.to_numpy(), b.column("tf").flatten().to_numpy()
            first, edge = _flat(b.column("first"))
            first = first.to_numpy()
            for i in np.argsort(-bound.max(axis=1, initial=-1), kind="stable"):
                item = np.flatnonzero(bound[i] >= floor)
                if not len(item):
                    continue
                own = q[start[i] : start[i + 1]]
                a, z = post[i], post[i + 1]
                at = np.flatnonzero(own[term[a:z]] >= 0)
                doc = np.searchsorted(first[edge[i] : edge[i + 1]], at, side="right") - 1
                kinds, column = np.unique(own[term[a:z][at]], return_inverse=True)
                value = np.zeros((docs[i + 1] - docs[i], len(kinds)), weights.dtype)
                value[doc, column] = part(tf[a:z][at].astype(np.int64), m[docs[i] + doc])
                score = (value @ weights[np.ix_(item, kinds)].T).astype(np.int64)
                d, c = np.nonzero(score >= floor[item])
                if len(d):
                    which = ids.take(pa.array(docs[i] + d))
                    null = which.is_null().to_numpy(zero_copy_only=False)
                    new = (item[c], score[d, c], np.where(null, (1 << 63) - 1, which.fill_null(0).to_numpy()), null)
                    held = _top([np.concatenate(x) for x in zip(held, new, strict=True)], k)
                    full = np.bincount(held[0], minlength=len(floor)) >= k
                    worst = np.full(len(floor), _EXACT * 512, np.int64)
                    np.minimum.at(worst, held[0], held[1])
                    floor = np.where(full, np.maximum(floor, worst), floor)
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2], mask=held[3].astype(bool))], names=["item", "score", "doc_id"])

    need = [c.split()[0] for c in _INDEX.split(", ") if not c.startswith(("block", "df"))]
    found = blocks.select(*need, *["items"] * chosen).mapInArrow(lean(scan), "item bigint, score bigint, doc_id bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 20, batch: int = 24_000_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each query (item_id, text) with a score above 0. batch: the most that a batch's number of queries
    times their characters is, about six times the weights that a task holds."""
    spark = index.blocks.sparkSession
    results = [spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")]
    with few_rows(spark):
        for items in _batches(queries, batch):
            if (found := _search(index, Queries.of(items), k)) is not None:
                results.append(found)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _search(index: Index, asked: Queries, k: int) -> DataFrame | None:
    if not len(asked.terms) or not index.documents:
        return None
    spark = index.blocks.sparkSession
    terms = spark.sparkContext.broadcast(asked.terms)
    view = _view(index.blocks, terms)
    df = np.zeros(len(asked.terms), np.int64)
    for r in view.select(F.explode(F.arrays_zip("q", "df")).alias("x")).groupBy("x.q").agg(F.sum("x.df").alias("df")).collect():
        df[r["q"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    sent = spark.sparkContext.broadcast(asked.weights(weight))
    least = np.ones(len(asked.names), np.int64)
    for many in ROUNDS:
        wanted = F.broadcast(_best_blocks(view, sent, least, many))  # `many` blocks a query at most
        found = _scored(index.blocks.join(wanted, "block"), terms, sent, least, k)
        for r in found.filter(F.col("rank") == k).collect():
            least[r["item"]] = r["score"]
    ranked = staged(_scored(index.blocks, terms, sent, least, k))
    names = spark.createDataFrame([(i, n) for i, n in enumerate(asked.names)], "item bigint, item_id bigint")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _batches(queries: DataFrame, limit: int) -> Iterator[list]:
    """Queries in batches of bounded size, one on the driver at a time."""
    batch, held = [], 0
    for r in queries.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len(r["text"] or "")
        if batch and (len(batch) + 1) * (held + n) > limit:
            yield batch
            batch, held = [], 0
        batch.append(r)
        held += n
    if batch:
        yield batch
