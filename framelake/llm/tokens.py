"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

Aho-Corasick finds all vocabulary pieces in a word in one pass; dynamic programming over the places
between characters keeps, for each, the best score of a way there and how many pieces it has. Ties
go as in the public implementation: starts are tried from left to right, and a later way
replaces an earlier one only if its score is greater, in 64-bit floats added from the left. A character that
is no piece by itself may be unknown, at 10 below the least score; unknown characters in a row are one piece.

The vocabulary is a public sentencepiece file's pieces with their scores. Words are split at white
space and start with the word mark, so a text's count is the sum over its words; a worker counts each word once.

Rows: a null or empty text has 0 tokens. Repeated rows and null ids are answered each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._subwords import vocabulary_path
from framelake.llm._words import Lexicon, Words, chunks, lean, sum_by_text

MARK = "▁"
#: Unicode white space beyond ASCII's, at which words are split too.
_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_WORDS = re.compile(f"{MARK}[^{MARK}]*")
UNKNOWN_PENALTY = 10.0

_open: dict[str, Lexicon] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of every ordinary piece of a sentencepiece file, by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(path))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Counting:
    """Counts a word's pieces."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        n = len(word)
        by_start: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (size, score) in self.automaton.iter(word):
            by_start[end + 1 - size].append((end + 1, score))
        best, count, last_unknown = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here, single = best[at], False
            for end, score in by_start[at]:  # by length, as the automaton goes from left to right
                single = single or end == at + 1
                if best[end] is None or here + score > best[end]:
                    best[end], count[end], last_unknown[end] = here + score, count[at] + 1, False
            if not single and (best[at + 1] is None or here + self.unknown > best[at + 1]):
                best[at + 1], count[at + 1], last_unknown[at + 1] = here + self.unknown, count[at] + (not last_unknown[at]), True
        return count[n]


def _lexicon(path: str) -> Lexicon:
    if path not in _open:
        counting = Counting(vocabulary(path))

        def compute(words: list[bytes]) -> list[np.ndarray]:
            out = np.zeros(len(words), np.int64)
            for i, w in enumerate(words):
                for x in _SPACES.split(w.decode("utf-8", "replace")):
                    if x:  # a mark in the text starts a word of its own
                        out[i] += sum(map(counting.count, _WORDS.findall(x if x[0] == MARK else MARK + x)))
            return [out]

        _open[path] = Lexicon(compute)
    return _open[path]


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_words, n_tokens of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(b.column("text"))
            row, (count,) = _lexicon(vocabulary).lookup(w)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(sum_by_text(count[row], w.first))], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(scan), "doc_id bigint, n_words bigint, n_tokens bigint")
