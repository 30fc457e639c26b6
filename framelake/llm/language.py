"""Language identification by interpolated Kneser-Ney character models.

A text is its words' letters: lower-cased runs of letters, each between a start and an end mark, so a
character's context never leaves its word and a word's score is found once for each worker. For every n up to
`order`, n-grams of all languages stand in one sorted array of hashes, with a row of values for each: the
discounted probability of its last character and, for contexts, the weight of the shorter context.
The language with the lowest cross-entropy per character wins; a text is rejected if that
cross-entropy lies beyond what the language's own training texts of such a length show.

The models are fitted on a bounded sample of labelled rows: whole documents, by a hash of their id, of
about `sample_bytes` a language. Counting the sample is distributed; the driver sees its distinct words.

Rows: null texts and texts without letters are `und` with score 0 and are rejected. Ties go to the language
first by name. Rows with a null lang teach nothing. Without any labelled row all texts are `und`. Repeated rows
are answered each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._stage import fold
from framelake.llm._words import Lexicon, Words, chunks, lean, mix, sum_by_text

_LETTERS = re.compile(r"[^\W\d_]+")
_START, _END = 1, 2
_ALPHABET = 1 << 17
_HASH = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def segments(word: bytes) -> list[str]:
    """Runs of letters. What only counts as alphanumeric (², ½, ①, Ⅷ) is none."""
    found = _LETTERS.findall(word.decode("utf-8", "replace").lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for run in found for part in "".join(c if c.isalpha() else " " for c in run).split()]


def _spell(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes with marks, depth of each code in its part, part of each code)."""
    length = np.fromiter(map(len, parts), np.int64, len(parts)) + 2
    code = np.frombuffer("".join(f"\x01{p}\x02" for p in parts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    part = np.repeat(np.arange(len(parts)), length)
    return code, np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length), part


def _gram_hashes(code: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1: a hash of the n codes that end at each place (meaningless where fewer exist)."""
    out, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, order + 1):
        back = np.zeros(len(code), np.uint64)
        back[n - 1 :] = code[: len(code) - n + 1]
        h = mix(h * _HASH + back + np.uint64(n))
        out.append(h)
    return out


class Model:
    """Sorted hash arrays for each n: grams with their discounted probabilities, contexts with their weights."""

    def __init__(self, langs: list[str], order: int):
        self.langs, self.order = langs, order
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.limit = np.full(len(langs), np.inf)
        self.spread = np.zeros(len(langs))

    @staticmethod
    def fit(counts: dict[str, Counter], order: int) -> Model:
        langs = sorted(counts)
        model = Model(langs, order)
        spelled = {}
        for lang in langs:
            parts = list(counts[lang])
            code, depth, part = _spell(parts)
            weight = np.fromiter(counts[lang].values(), np.float64, len(parts))[part]
            spelled[lang] = depth, weight, _gram_hashes(code, order)
        for n in range(1, order + 1):
            gram_rows, context_rows = {}, {}
            for k, lang in enumerate(langs):
                depth, weight, hashes = spelled[lang]
                place = np.flatnonzero((depth >= n - 1) & (depth > 0))  # the start mark is never predicted
                gram, first, inverse = np.unique(hashes[n - 1][place], return_index=True, return_inverse=True)
                at = place[first]
                value = np.bincount(inverse, weight[place], len(gram))
                if n < order:
                    # How many different characters come before; grams at the start mark have none and keep their counts.
                    longer = np.flatnonzero(depth >= n)
                    longer = longer[depth[longer] > 0]
                    _, one = np.unique(hashes[n][longer], return_index=True)
                    before = np.bincount(np.searchsorted(gram, hashes[n - 1][longer[one]]), minlength=len(gram)).astype(float)
                    value = np.where(depth[at] == n - 1, value, np.maximum(before, 1.0))
                n1, n2 = (value == 1).sum(), (value == 2).sum()
                off = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                context = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(gram), np.uint64)
                keys, group = np.unique(context, return_inverse=True)
                total = np.bincount(group, value, len(keys))
                kinds = np.bincount(group, minlength=len(keys))
                gram_rows[k] = gram, np.maximum(value - off, 0) / total[group]
                context_rows[k] = keys, off * kinds / total
            model.grams.append(_rows(gram_rows, len(langs), 0.0))
            model.contexts.append(_rows(context_rows, len(langs), 1.0))
        return model

    def log_prob(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(natural log probability of each part for each language, codes predicted in each part)."""
        out, n_codes = np.zeros((len(parts), len(self.langs))), np.zeros(len(parts), np.int64)
        for a in range(0, len(parts), 20_000):
            some = parts[a : a + 20_000]
            code, depth, part = _spell(some)
            hashes = _gram_hashes(code, self.order)
            p = np.full((len(code), len(self.langs)), 1.0 / _ALPHABET, np.float32)
            for n in range(1, len(self.grams) + 1):
                place = np.flatnonzero((depth >= n - 1) & (depth > 0))
                context = hashes[n - 2][place - 1] if n > 1 else np.zeros(len(place), np.uint64)
                p[place] = _get(self.grams[n - 1], hashes[n - 1][place], 0.0) + _get(self.contexts[n - 1], context, 1.0) * p[place]
            p[depth == 0] = 1.0
            start = np.flatnonzero(depth == 0)
            if len(start):
                out[a : a + len(some)] = np.add.reduceat(np.log(np.maximum(p, 1e-30)).astype(np.float64), start)
                n_codes[a : a + len(some)] = np.diff(np.append(start, len(code))) - 1
        return out, n_codes

    def lexicon(self) -> Lexicon:
        def compute(words: list[bytes]) -> list[np.ndarray]:
            lists = [segments(w) for w in words]
            owner = np.repeat(np.arange(len(words)), [len(x) for x in lists])
            score, n = self.log_prob([p for x in lists for p in x])
            table = np.zeros((len(words), len(self.langs) + 1))
            np.add.at(table, owner, np.column_stack([score, n]))
            return [table.astype(np.float32)]

        return Lexicon(compute)


def _rows(found: dict[int, tuple[np.ndarray, np.ndarray]], width: int, default: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in found.values()]))
    values = np.full((len(keys), width), default, np.float32)
    for k, (own, value) in found.items():
        values[np.searchsorted(keys, own), k] = value
    return keys, values


def _get(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, default: float) -> np.ndarray:
    keys, values = table
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    out = values[at]
    out[keys[at] != h] = default
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _judge(m: Model, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(language, score, cross-entropy, letters and ends counted, rejected) of each text."""
    lexicon = m.__dict__.get("_lexicon") or m.__dict__.setdefault("_lexicon", m.lexicon())  # one for each worker's copy of the model
    w = Words(texts)
    row, (table,) = lexicon.lookup(w)
    total = sum_by_text(table[row].astype(np.float64), w.first)
    n = total[:, -1]
    some = n > 0
    name = np.full(len(n), UNKNOWN, object)
    score, entropy, rejected = np.zeros(len(n)), np.full(len(n), np.nan), np.ones(len(n), bool)
    if m.langs:
        h = -total[some, :-1] / n[some, None]
        best = h.argmin(axis=1)
        low = h[np.arange(len(best)), best]
        # Texts longer than 40 characters are no surer than that: characters aren't independent.
        score[some] = 1 / np.exp(np.minimum((low[:, None] - h) * np.minimum(n[some, None], 40), 0)).sum(axis=1)
        name[some] = np.array(m.langs, object)[best]
        entropy[some] = low
        rejected[some] = low > m.limit[best] + m.spread[best] / np.sqrt(n[some])
    return name, score, entropy, n, rejected


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all their columns, whose text the model does not reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield b.filter(pa.array(~_judge(sent.value, b.column(b.schema.get_field_index("text")))[-1]))

    return docs.mapInArrow(lean(scan), docs.schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, entropy, n_letters, rejected of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            name, score, entropy, n, rejected = _judge(sent.value, b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(name, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(n.astype(np.int64)), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "entropy", "n_letters", "rejected"],
            )

    return _texts(docs).mapInArrow(lean(scan), "doc_id bigint, lang_pred string, score double, entropy double, n_letters bigint, rejected boolean")


def fit(docs: DataFrame, order: int = 4, sample_bytes: int = 3_000_000) -> Model:
    """Models of the languages of docs' rows with a lang, but those of the fold held out.

    sample_bytes: about how much text a language teaches (rows are drawn by a hash of their id, whole, whatever their length).
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0))
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["size"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    if not sizes:
        return Model([], order)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample_bytes / max(size, 1)) * 1_000_000))) for lang, size in sizes.items()])
    sample = rows.filter(draw < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            found: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(segments(text.encode()))
            flat = [(lang, s, n) for lang, c in found.items() for s, n in c.items()]
            a, s, n = zip(*flat, strict=True) if flat else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(s, pa.string()), pa.array(n, pa.int64())], names=["lang", "part", "n"])

    counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for r in sample.select("lang", "text").mapInArrow(lean(count), "lang string, part string, n bigint").groupBy("lang", "part").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["part"]] = r["n"]
    counts = {lang: c for lang, c in counts.items() if c}
    if not counts:
        return Model([], order)
    model = Model.fit(counts, order)
    # Rejection: cross-entropy of a language's own texts; far beyond it, and further for short texts, is not that language.
    own = predict(sample, model).join(sample.select("doc_id", "lang"), "doc_id").filter("lang = lang_pred and n_letters >= 20")
    seen = {r["lang"]: r for r in own.groupBy("lang").agg(F.percentile_approx("entropy", 0.99, 1000).alias("high"), F.avg("entropy").alias("mean")).collect()}
    for k, lang in enumerate(model.langs):
        if lang in seen:
            model.limit[k] = seen[lang]["high"] + 0.5 * seen[lang]["mean"]
            model.spread[k] = 3 * seen[lang]["mean"]
    return model
