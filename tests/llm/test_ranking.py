"""Ranked search against a full scoring of all documents."""

import math
import re
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest

from framelake.llm import ranking

SCHEMA = "doc_id bigint, text string, score string, block string"
TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def by_hand(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t, *_ in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for d, b, n in bags:
            m = 75 + 25 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, q in asked.items() if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def some_docs(seed, n=300):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{'' if i % 9 else 'é'}w{i}" for i in range(400)]
    chance = 1 / np.arange(1, 401)
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 120)), p=chance / chance.sum())).upper(), "s", "b") for i in range(n)]
    rows += [(n, None, "s", "b"), (n + 1, "", "s", "b"), (n + 2, "?! --", "s", "b"), (None, "W1 w2 w399", "s", "b"), (5, rows[5][1], "s", "b"), (n + 3, rows[5][1], "s", "b"), (n + 4, "w300 " * 50_000, "s", "b")]
    rows += [(1000 + i, "w7 w350,w351", "s", "b") for i in range(40)]  # ties beyond k
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_the_best_are_those_of_a_full_scoring(spark, seed):
    rng = np.random.default_rng(seed + 50)
    docs = some_docs(seed)
    items = [(i, " ".join(f"w{k}" for k in rng.integers(0, 420, int(rng.integers(1, 30))))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "nowhere"), (93, "w350 W350 w7"), (None, "w1 w2"), (94, "éw9é ÉW9")]
    index = ranking.build(spark.createDataFrame(docs, SCHEMA).repartition(5), documents=8)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    for k in (3, 20):
        want = by_hand(docs, items, k)
        got = sorted(map(tuple, ranking.search(index, asked, k=k).collect()), key=str)
        assert got == want
    assert sorted(map(tuple, ranking.search(index, asked, k=20, batch=2_000).collect()), key=str) == want  # a few queries at a time


def test_blocks_hold_each_terms_maximum(spark):
    docs = some_docs(3, 100)
    index = ranking.build(spark.createDataFrame(docs, SCHEMA).repartition(2), documents=16)
    seen = 0
    for b in index.blocks.collect():
        best, held = Counter(), Counter()
        for i, m in enumerate(b["m"]):
            for t, tf in zip(b["term"][b["first"][i] : b["first"][i + 1]], b["tf"][b["first"][i] : b["first"][i + 1]], strict=True):
                best[t] = max(best[t], 10**9 * tf // (1000 * tf + 12 * m))
                held[t] += 1
        assert [best[i] for i in range(len(b["terms"]))] == b["most"] and [held[i] for i in range(len(b["terms"]))] == b["df"]
        assert len(b["doc_id"]) <= 16 and len(set(b["terms"])) == len(b["terms"])
        seen += len(b["doc_id"])
    assert seen == index.documents == sum(1 for r in docs if terms(r[1]))


def test_large_weights_are_summed_as_integers():
    q = ranking.Queries.of([{"item_id": 1, "text": "a " * 3 + "b"}])
    assert q.weights(np.array([5, 7])).dtype == np.float64 and q.weights(np.array([1 << 33, 7])).dtype == np.int64
    assert q.weights(np.array([5, 7])).tolist() == [[15, 7]]


def test_pruned_blocks_are_not_opened(spark):
    """With one rare term a block without it has no bound, so of 40 blocks a single one is scored."""
    docs = [(i, f"common w{i}") for i in range(400)]
    index = ranking.build(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(1), documents=10)
    terms_ = spark.sparkContext.broadcast(ranking.Queries.of([{"item_id": 0, "text": "w77"}]).terms)
    view = ranking._view(index.blocks, terms_)
    best = ranking._best_blocks(view, spark.sparkContext.broadcast(np.array([[1000.0]])), np.ones(1, np.int64), 8).collect()
    assert len(best) == 1 and best[0]["items"] == [0]


def test_empty_tables(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a", "s", "b")], SCHEMA)
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranking.search(ranking.build(empty), items).count() == 0
    assert ranking.search(ranking.build(one), items.limit(0)).count() == 0
    assert [tuple(r) for r in ranking.search(ranking.build(one), items).collect()] == by_hand([(1, "a")], [(1, "a")], 20)


def test_blocks_are_written_and_read_a_few_at_a_time(spark):
    """Memory follows neither a task's share of the texts nor a file's size: groups of a file, and what is read from them at once, hold few blocks."""
    docs = spark.createDataFrame([(i, f"common w{i}") for i in range(300)], "doc_id bigint, text string").repartition(1)
    files = ranking.build(docs, documents=1).blocks.inputFiles()
    meta = [pq.read_metadata(urlparse(f).path) for f in files]
    groups = [m.row_group(g).num_rows for m in meta for g in range(m.num_row_groups)]
    assert sum(groups) == 300 and max(groups) <= 64
    keys = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in keys]
    with ranking.few_rows(spark):
        assert [spark.conf.get(k) for k in keys] == ["16", "16"]
    assert [spark.conf.get(k) for k in keys] == before
