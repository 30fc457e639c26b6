"""The toxicity classifier: n-grams and ratios by hand, the regression against its gradient, held-out accuracy, rims."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from framelake.llm import toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, score string"


def grams_by_hand(text):
    """The distinct n-grams of the words of a text, marks at their ends."""
    words, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if c.isascii() else c
        if c.isascii() and not c.isalnum():
            words.append(word)
            word = ""
        else:
            word += c
    return {f"<{w}>"[i : i + n] for w in words if w for n in toxicity.ORDERS for i in range(len(w) + 3 - n)}


def bucket(gram):
    """As word_grams has it, for one n-gram: hashed from a word that is nothing but it."""
    marked = gram.startswith("<") or gram.endswith(">")
    word = gram.strip("<>") if marked else gram
    starts, lengths, flat = toxicity.word_grams([word.encode()])
    text, found = f"<{word}>", []
    for n in toxicity.ORDERS:
        found += [text[i : i + n] for i in range(len(text) - n + 1)]
    return int(flat[found.index(gram)])


def test_ngrams_are_those_by_hand():
    texts = ["Hello, WORLD! naïve çé", "", None, "a", "ab ab x1y2 日本語です", "He said: 'hello'"]
    text, feature = toxicity.features(pa.array(texts), toxicity.GramLexicon())
    for k, t in enumerate(texts):
        want = {bucket(g) for g in grams_by_hand(t)}
        got = feature[text == k].tolist()
        assert len(got) == len(set(got)) and set(got) == want


def test_regression_finds_the_minimum():
    rng = np.random.default_rng(0)
    x = rng.random((200, 12)) < 0.3
    y = (x[:, 0] | (x[:, 3] & x[:, 5])).astype(float)
    scale = rng.normal(1, 0.5, 12)
    row, feature = np.nonzero(x)
    bias, weight = toxicity.regress(row, feature, y, scale, l2=0.02)

    def loss(b, w):
        z = b + x @ (scale * w)
        share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        return float((share * (np.logaddexp(0, z) - y * z)).sum() + 0.01 * (w**2).sum())

    own = weight / scale
    best = loss(bias, own)
    for k in range(12):
        for step in (1e-3, -1e-3):
            moved = own.copy()
            moved[k] += step
            assert loss(bias, moved) > best - 1e-9
    assert loss(bias + 1e-3, own) > best - 1e-9 and loss(bias - 1e-3, own) > best - 1e-9


def labelled(rng, n, bad=0.3):
    stems = {"insult": ["gromb", "vlask", "krunt"], "plain": ["tolen", "marin", "besto", "falur", "quimo", "sedir"]}
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < bad
        words = [str(rng.choice(stems["plain"])) + str(rng.choice(["a", "en", "is", "or"])) for _ in range(30)]
        if toxic:
            for k in rng.integers(0, 30, 2):
                words[k] = str(rng.choice(stems["insult"])) + str(rng.choice(["a", "en", "is", "or", "ul"]))
        rows.append((i, " ".join(words), "x", "s", "n"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_unseen_forms_of_known_stems_are_caught(spark):
    rows, labels = labelled(np.random.default_rng(5), 400)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (900, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 90 and all(got[i]["predicted"] == labels[i][2] for i in held)
    # The ratios are those of the training rows alone: a count by hand of one stem's bucket.
    taught = [i for i, *_ in rows if i not in held]
    count = Counter()
    for i in taught:
        count[labels[i][2], "grom" in rows[i][1]] += 1
    k = model.keep[bucket("grom")]
    assert count[0, True] == 0 < count[1, True] and k >= 0 and model.weight[k] > 0
    odd = [(1, None), (2, ""), (3, "?!"), (4, "grombis " * 40_000), (4, "tolena"), (None, "vlaskor krunten")]
    odd_rows = toxicity.score(spark.createDataFrame([(*r, "x", "s", "n") for r in odd], SCHEMA), model).collect()
    by = {(r["doc_id"], r["predicted"]) for r in odd_rows}
    assert len(odd_rows) == 6 and (4, 1) in by and (4, 0) in by and (None, 1) in by
    empty = {r["score"] for r in odd_rows if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1 and 0 < empty.pop() < 0.7


def test_without_labels_of_both_kinds(spark):
    rows, _ = labelled(np.random.default_rng(1), 12)
    docs, schema = spark.createDataFrame(rows, SCHEMA), "doc_id bigint, quality int, toxic int"
    none = toxicity.fit(docs, spark.createDataFrame([], schema))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    clean = toxicity.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(12)], schema))
    n = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(12))
    assert {round(r["score"], 9) for r in toxicity.score(docs, clean).collect()} == {round(1 / (n + 2), 9)}
    assert toxicity.score(docs.limit(0), none).count() == 0
    assert toxicity.fit(docs.limit(0), spark.createDataFrame([(1, 1, 1)], schema)).bias == 0
