"""Quality rules learned from labelled statistics, as an ordered list of threshold conjunctions.

Statistics come from built-in functions in one pass over each text, within its row: nothing is exploded
or shuffled, so hot words and long texts only cost their own row. Rules are learned by sequential
covering on a bounded sample of labelled rows (`sample` rows at most, the least by a hash of the id):
a rule grows one condition at a time by information gain on two thirds of the sample, loses its last
conditions while that raises its worth on the other third, and takes the rows it covers with it. The
list becomes one Spark CASE expression.

Rows: a null text counts as empty. Labels: a doc_id with several labels counts as bad if any says so; null
labels are left out. Without labelled rows of both kinds the list is empty and only the fixed rule holds.
Repeated rows are answered each; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm._stage import fold, let

BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
#: What a condition may look at: column, and how it follows from the statistics.
FEATURES = ("n_words", "chars_per_word", "symbols_per_word", "dup_lines", "repeat_share", "upper_share", "marks_per_word", "n_lines")


def _without(text: Column, chars) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""

    def covered(places: Column) -> Column:
        """How many words the windows at these sorted places cover."""
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def by_sorting(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda s: F.transform(
                F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["i"],
            ),
        )
        return covered(F.array_sort(twice))

    def count(h: Column) -> Column:
        twice = let(F.array_sort(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1) == x, F.lit(False)))))
        places = F.sequence(F.lit(0), F.size(h) - 1)

        def few_or_many(d: Column) -> Column:  # few repeated windows: look each up among them; many: sort
            few = covered(F.filter(places, lambda i: F.array_contains(d, F.get(h, i))))
            return F.when(F.size(d) == 0, 0).when(F.size(d) <= 24, few).otherwise(by_sorting(h))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(twice, few_or_many))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 4, 0).otherwise(let(windows(words), count))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text and the statistics of each document, all long."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    t = F.col("text")
    trimmed = F.btrim(t, F.lit("".join(BLANKS)))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit("".join(BLANKS)))) > 0)
    of_words = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).cast("bigint").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    long = lambda c: c.cast("bigint")
    made = rows.select(
        "doc_id",
        of_words.alias("w"),
        of_lines.alias("l"),
        long(F.length(_without(t, BLANKS))).alias("word_chars"),
        long(F.octet_length(t) - F.octet_length(_without(t, SYMBOLS))).alias("n_symbols"),
        long(F.octet_length(t) - F.octet_length(_without(t, "!?"))).alias("n_marks"),
        long(F.octet_length(F.regexp_replace(t, "[^A-Z]+", ""))).alias("n_upper"),
    )
    return made.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_marks", "n_upper")


def _feature(name: str) -> Column:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": per_word("n_repeat_words"),
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "marks_per_word": per_word("n_marks"),
        "n_lines": F.col("n_lines").cast("double"),
    }[name]


def between(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Thresholds half way from each given value to the next greater one that occurs."""
    v = np.unique(values)
    i = np.unique(np.searchsorted(v, at, side="right"))
    i = i[(i > 0) & (i < len(v))]
    return (v[i - 1] + v[i]) / 2


def learn(x: np.ndarray, bad: np.ndarray, order: np.ndarray, max_rules: int = 16, max_conditions: int = 4, cuts: int = 48) -> list[list[tuple[int, bool, float]]]:
    """Rules for bad rows, each a list of (feature, greater?, threshold); order: a hash of each row that splits them."""
    growing = order % 3 != 0
    thresholds = [between(x[:, f], np.quantile(x[:, f], np.linspace(0, 1, cuts))) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    rules, left = [], np.ones(len(x), bool)

    def match(rule, rows: np.ndarray) -> np.ndarray:
        hit = rows.copy()
        for f, above, t in rule:
            hit &= (x[:, f] > t) if above else (x[:, f] <= t)
        return hit

    while len(rules) < max_rules:
        rule, inside = [], left & growing
        while len(rule) < max_conditions:
            p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
            if not p0 or not n0:
                break
            best, choice = 1e-9, None
            for f in range(x.shape[1]):
                v, b = x[inside, f], bad[inside]
                for above in (True, False):
                    at = np.searchsorted(thresholds[f], v, side="left")
                    p, n = np.bincount(at[b], minlength=cuts + 1), np.bincount(at[~b], minlength=cuts + 1)
                    # v <= t[k] exactly when at <= k
                    p, n = np.cumsum(p)[: len(thresholds[f])], np.cumsum(n)[: len(thresholds[f])]
                    if above:
                        p, n = p0 - p, n0 - n
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 0.0)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, choice = float(gain[k]), (f, above, float(thresholds[f][k]))
            if choice is None:
                break
            rule.append(choice)
            inside = match([choice], inside)
        if not rule:
            break

        def worth(r) -> float:
            hit = match(r, left & ~growing)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        hit = match(rule, left)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if worth(rule) <= 0.5 or p < 4 * max(n, 1) - 3:  # not right often enough: nothing further is
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[list[tuple[int, bool, float]]]) -> Column:
    """The decision list as an expression over the statistics: true if kept."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for f, above, t in rule:
            test = test & ((_feature(FEATURES[f]) > t) if above else (_feature(FEATURES[f]) <= t))
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[list[tuple[int, bool, float]]]:
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold("doc_id", 5) != 0))
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("order", F.xxhash64("doc_id")).orderBy("order").limit(sample)
    known = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).join(F.broadcast(chosen), "doc_id")
    rows = known.select("order", "quality", *[_feature(f).alias(f) for f in FEATURES]).collect()
    if not rows:
        return []
    a = np.array([[r[f] for f in FEATURES] for r in rows])
    return learn(a, np.array([r["quality"] == 0 for r in rows]), np.array([r["order"] for r in rows]))


def apply_rules(docs: DataFrame, rules: list, min_words: int = 50) -> DataFrame:
    """The statistics, base_failed and kept of each document."""
    s = statistics(docs)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return s.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
