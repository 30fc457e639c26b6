"""Removal of repeated runs of lines, by overlapping three-line windows.

A document's lines are its text split at newlines. Lines with nothing but ASCII white space are not
counted and stay where they are; each three other lines in a row make a window. A window that the
corpus holds more than once is kept where it stands first, by (doc_id, position), and all lines of
its later occurrences go, overlaps merged.

Rows: a null or empty text has no lines and comes back as it is; so does a text of fewer than three
lines. Rows that share a doc_id are one document for the order: a window at the same position of each
counts as one occurrence. Rows with a null doc_id come back unchanged and are no one's first
occurrence. Extra columns pass through. Built-in functions only: a window's 128-bit hash is grouped with
map-side minima, so a hot window is one row for each task there. Its occurrences (a document and a position each) then meet its first
in a join that adaptive execution splits where one key is large; the lines themselves never leave their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._stage import let, staged

_BLANK = " \t\n\x0b\x0c\r"


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(_BLANK))) > 0


def line_windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, pos (from 0, among the lines that count), h1, h2 of each window of each document."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    hashed = F.transform(F.filter(F.split("text", "\n", -1), _has_word), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))

    def window(h: Column, i: Column) -> Column:
        near = [F.get(h, i + k) for k in range(size)]
        return F.struct(F.xxhash64(*[n["a"] for n in near]).alias("h1"), F.xxhash64(F.lit(3), *[n["b"] for n in near]).alias("h2"))

    windows = let(hashed, lambda h: F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: window(h, i))))
    return rows.select("doc_id", F.posexplode(windows).alias("pos", "w")).select("doc_id", "pos", "w.h1", "w.h2")


def repeated_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, gone: sorted positions of the window starts to remove, of the documents that have any."""
    windows = staged(line_windows(docs, size))
    firsts = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max(F.struct("doc_id", "pos")).alias("last"))
    firsts = firsts.filter(F.col("first") != F.col("last")).select("h1", "h2", "first")
    later = windows.join(firsts, ["h1", "h2"]).filter(F.struct("doc_id", "pos") != F.col("first"))
    return later.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def remove_repeated_lines(docs: DataFrame, size: int = 3, counts: bool = True) -> DataFrame:
    """docs with text replaced; with counts also n_lines and n_removed (lines that count, before; lines removed), which
    take the place of columns of these names."""
    names = [c for c in docs.columns if c != "text" and not (counts and c in ("n_lines", "n_removed"))]
    gone = repeated_lines(docs.select("doc_id", "text"), size).withColumnRenamed("doc_id", "__framelake_doc_id").withColumnRenamed("gone", "__framelake_gone")
    joined = docs.join(gone, docs["doc_id"] == gone["__framelake_doc_id"], "left")
    # Window starts mark the lines from start to start + size; as line numbers that is at most size times as many.
    covered = F.array_distinct(F.flatten(F.transform("__framelake_gone", lambda p: F.sequence(p, p + (size - 1)))))
    text = F.col("text")

    def without(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        places = F.filter(every, lambda i: _has_word(F.get(lines, i)))  # where the lines that count stand
        kept = let(places, lambda at: F.array_except(every, F.transform(covered, lambda c: F.get(at, c))))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    gone_here = F.col("__framelake_gone")
    out = joined.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(gone_here.isNull(), text).otherwise(let(F.split(text, "\n", -1), without)).alias("text"),
        *(
            (
                F.when(text.isNull(), 0).otherwise(F.size(F.filter(F.split(text, "\n", -1), _has_word))).cast("bigint").alias("n_lines"),
                F.when(gone_here.isNull(), 0).otherwise(F.size(covered)).cast("bigint").alias("n_removed"),
            )
            if counts
            else ()
        ),
    )
    return out if counts else out.select(*[F.col(f"`{c}`") for c in docs.columns])
