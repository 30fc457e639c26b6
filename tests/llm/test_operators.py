"""Each operator against brute force on small texts: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import _subwords, decontamination, language, lines, lm, near_dup, packing, quality, rules, substrings, tokens
from framelake.llm._words import Words, grams

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, score string"


def random_docs(seed=0, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 7)))
    vocabulary = [word() for _ in range(300)]
    texts = []
    for i in range(n):
        size = int(rng.integers(1, 160))
        w = [vocabulary[k] for k in rng.integers(0, len(vocabulary), size)]
        if i % 4 == 1 and i > 4:  # a near copy
            w = texts[i - 3].split()
            w[int(rng.integers(0, len(w)))] = "changed"
        if i % 7 == 3:
            w += texts[i - 2].split()[:50]
        text = " ".join(w)
        texts.append("\n".join(text[k : k + 40] for k in range(0, len(text), 40)) if i % 5 == 0 else text)
    texts += [None, "", " \n\t ", "one", "ONE", "a b c d", texts[7], texts[7], "long " * 30000, "\x0b", "naïve 日本語 🙂", "x\n\n\ny\nz\nx\n\n\ny\nz"]
    langs = ["en" if i % 2 else "fr" for i in range(len(texts))]
    return [(i, t, langs[i], "s", None if t is None else len(t), "k", "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return random_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text, lower=False):
    b = (text or "").encode()
    return (b.lower() if lower else b).split()


def test_words_are_those_of_a_split(rows):
    texts = [r[1] for r in rows]
    w = Words(pa.array(texts), lower=True)
    assert [[w.word(k) for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))] == [split(t, True) for t in texts]


def test_grams_differ_when_words_do():
    h = np.arange(1, 50, dtype=np.uint64)
    for k in (1, 2, 3, 5, 7, 16, 35):
        g = grams(h, k)[: 50 - k]
        again = grams(np.concatenate([h[7:], h[7:]]), k)
        assert len(np.unique(g)) == len(g) and again[0] == g[7]


def components_by_hand(rows, percent):
    sets = {}
    for d, t, *_ in rows:
        w = split(t, True)
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("tile", [2, 1024])
def test_near_duplicates(docs, rows, empty, tile):
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs, percent=85, tile=tile).collect()}
    want = components_by_hand(rows, 85)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())
    if tile > 2:
        assert near_dup.near_duplicates(empty).count() == 0


def test_dense_near_copies_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for d in range(120):
        w = list(base)
        for p in rng.integers(0, 150, int(rng.integers(0, 6))):
            w[p] = f"x{rng.integers(0, 3)}"
        rows.append((d, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=85, tile=16).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_by_hand(rows, 85)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert packing.pack(df).count() == 5
    assert lines.remove_repeated_lines(df).count() == 5
    assert tokens.count_tokens(df).count() == 5
    assert rules.apply_rules(df, []).count() == 5
    assert substrings.remove_repeats(df).count() == 5


def test_a_doc_id_with_several_texts_links_them(spark):
    """Rows of one doc_id count as linked; each row keeps its own set's size. Sets of the same least doc_id are told apart."""
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 60, 40))
    a, b, c, d, e = (text() for _ in range(5))
    near = lambda t: t + " more"
    rows = [(3, a), (5, a), (5, b), (9, b), (20, c), (20, d), (21, near(c)), (22, near(d)), (30, near(near(d))), (40, e), (40, e), (41, None), (41, near(b)), (50, text())]
    for i in range(60, 90):
        rows += [(i, near(rows[int(rng.integers(0, len(rows)))][1] or a)) for _ in range(1 + i % 2)]
    words = {k: split(t, True) for k, (_, t) in enumerate(rows)}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in words.items()}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or (n and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n)):
                root[find(i)] = find(j)
    # A row without words is linked with nothing, also not with the other rows of its doc_id.
    least = {}
    for k, (d_, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), d_), d_)
    want = sorted((d_, len(sets[k]), least[find(k)] if sets[k] else d_) for k, (d_, _) in enumerate(rows))
    for tile in (2, 1024):
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), percent=85, tile=tile).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
        assert len({r["component_id"] for r in got if r["doc_id"] in (3, 5, 9)}) == 1


@pytest.mark.parametrize("window", [5, 35])
def test_repeated_windows_go(docs, rows, empty, window):
    count = Counter()
    for _, t, *_ in rows:
        w = split(t)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    anchor = 3 if window == 5 else 16
    for heavy in ({}, {"group": 1}):
        for r in substrings.remove_repeats(docs, window=window, anchor=anchor, **heavy).collect():
            w = split(rows[r["doc_id"]][1])
            gone = [False] * len(w)
            for i in range(len(w) - window + 1):
                if count[tuple(w[i : i + window])] > 1:
                    gone[i : i + window] = [True] * window
            kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
            assert (r["n_words"], r["n_removed"], r["kept_sha256"], r["text"].encode()) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept)
    assert substrings.remove_repeats(empty).count() == 0


def test_repeats_of_rows_that_share_an_id(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, words(0, 200)), (1, "short text here"), (2, words(0, 200)), (1, words(1, 200)), (None, words(2, 60)), (None, words(3, 60) + " " + words(2, 40)), (None, None), (-1, words(4, 50)), (7, words(5, 40)), (7, words(5, 40))]
    got = substrings.remove_repeats(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, h string, spans int").repartition(3))
    want = [(1, "", 200), (1, "short text here", 0), (2, "", 200), (1, words(1, 200), 0), (None, " ".join(words(2, 60).split()[40:]), 40), (None, words(3, 60), 40), (None, "", 0), (-1, words(4, 50), 0), (7, "", 40), (7, "", 40)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_tree_nodes_give_every_shared_window():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 400).astype(str)
    w = Words(pa.array([" ".join(text[:200]), " ".join(text[150:])]))
    s = substrings.Suffixes(w, 8, 3)
    which, before = substrings.repeats(s.records(), s.left)
    got = set((s.at[which] - before).tolist())
    count = Counter(tuple(w.hash[i : i + 8]) for i in np.flatnonzero(w.full(8)))
    assert got == {i for i in np.flatnonzero(w.full(8)).tolist() if count[tuple(w.hash[i : i + 8])] > 1} and got


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(_subwords.vocabulary_path())
    got = packing.pack(docs, capacity=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [(p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces] == [
            (k, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))
        ]
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= -(-total // 64) * 1.02 + 1
    assert packing.pack(empty).count() == 0


def test_packing_in_any_order(spark):
    # Long pieces first: far more than a buffer of bins just over half full wait for the short ones.
    texts = ["a " * 34] * 300 + ["a " * 24] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = packing.pack(docs, capacity=64, buffer=256).collect()
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert sorted(r["doc_id"] for r in got) == list(range(600)) and max(used.values()) <= 64
    assert len(used) <= 330  # 300 are the least


def test_packing_nothing_fits(spark):
    docs = spark.createDataFrame([(i, "a " * 39) for i in range(200)] + [(200, "a " * 19), (201, "a " * 19)], "doc_id bigint, text string").coalesce(1)
    assert packing.pack(docs, capacity=64, buffer=32).select("sequence_id").distinct().count() == 200


def test_best_fit_keeps_sizes():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 65, 500).tolist()
    bins = packing.best_fit(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= sum(sizes) / 64 * 1.08 + 1  # half the items fill over half a bin


def test_word_ids_are_text_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(_subwords.vocabulary_path())
    texts = ["Hello's  wörld\n\tfoo<|endoftext|>bar 'start \x01 a\x01b x\x1cy", "", None, "ΑΣ ΑΣ. é 'S \"'s 12a3 \x85x\xa0y"]
    ids, off = _subwords.encode(pa.array(texts))
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_contamination(spark, docs, rows, block_words):
    items = [(k, " ".join(split(rows[k][1].replace("\n", " ")) and rows[k][1].split()[3:20])) for k in (8, 9, 14, 22)] + [(90, "one"), (91, None), (None, "one"), (92, "A  b,C d"), (92, "A  b,C d")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    word = __import__("re").compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").encode().lower())
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w and i is not None else 0):
            windows[tuple(w[a : a + k])].add(str(i))
    for r in decontamination.find_contamination(docs, bench, block_words=block_words).collect():
        w = cut(rows[r["doc_id"]][1])
        hit, found = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if got := windows.get(tuple(w[a : a + k])):
                    found |= got
                    hit[a : a + k] = [True] * k
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), sum(hit), sorted(found), any(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and r["n_items"] == len(found)


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_clean_rows_are_those_without_a_hit(spark, docs, rows, block_words):
    bench = spark.createDataFrame([(k, " ".join(rows[k][1].split()[3:20])) for k in (8, 9, 14, 22)] + [(90, "one"), (91, None)], "item_id bigint, text string")
    clean = {r["doc_id"] for r in decontamination.find_contamination(docs, bench).filter("not contaminated").collect()}
    left = decontamination.clean(docs, bench, block_words=block_words)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == clean and 0 < len(clean) < len(rows)


def test_hot_words_and_clashing_columns(spark):
    # Every window of every item has the same words but for one; documents hold them over and over.
    items = [(k, " ".join(["a"] * 12 + [f"k{k % 7}"] + ["a"] * 12)) for k in range(40)]
    rows = [(1, "a " * 5000, [1], "x"), (2, "a " * 30 + "k3 " + "a " * 30, None, None), (3, "b", None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, items array<int>, spans string")
    got = {r["doc_id"]: r for r in decontamination.find_contamination(docs, spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert got[1]["n_hit"] == 5000 and got[1]["n_items"] == 40 and got[2]["n_hit"] == 61 and got[2]["n_items"] == 40 and got[3]["n_hit"] == got[None]["n_words"] == 0


def test_no_benchmark_finds_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.find_contamination(docs, none).filter("contaminated").count() == 0
    assert decontamination.find_contamination(empty, none).count() == 0


def test_repeated_lines(docs, rows, empty):
    first, want = {}, {}
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        at = [i for i, x in enumerate(ls) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for p in range(len(at) - 2):
            key = tuple(ls[at[p + q]] for q in range(3))
            if first.setdefault(key, (d, p)) != (d, p):
                gone |= {p, p + 1, p + 2}
        drop = {at[x] for x in gone}
        want[d] = (None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in drop), len(at), len(gone))
    out = lines.remove_repeated_lines(docs)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "kept", "score", "text", "n_lines", "n_removed"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()} == want
    assert lines.remove_repeated_lines(empty).count() == 0


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.Unigram([("<unk>", 0.0), *tokens.vocabulary("piece_bpe_32k.model")], unk_id=0))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement=tokens.MARK, prepend_scheme="always")])
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs).collect()}
    assert got == {d: len(tok.encode(t or "").ids) for d, t, *_ in rows}


def test_statistics_for_rules(docs, rows):
    for r in rules.apply_rules(docs, []).collect():
        t = rows[r["doc_id"]][1] or ""
        w = split(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = [False] * len(w)
        for i in range(len(w) - 2):
            if c[tuple(w[i : i + 3])] > 1:
                hit[i : i + 3] = [True] * 3
        ls = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(s) for s in rules.SYMBOLS), len(ls) - len(set(ls)), sum(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * sum(hit) > 50 * len(w)) and r["kept"] == (not r["base_failed"])


def test_rules_are_learned_and_native(spark, docs):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (600, 3))
    bad = (x[:, 1] > 0.8) | ((x[:, 0] < 0.3) & (x[:, 2] > 0.6))
    learned = rules.learn(x, bad, rng.integers(0, 1 << 40, 600))
    hit = np.zeros(600, bool)
    for rule in learned:
        m = np.ones(600, bool)
        for f, above, t in rule:
            m &= (x[:, f] > t) if above else (x[:, f] <= t)
        hit |= m
    assert (hit == bad).mean() > 0.95
    plan = rules.apply_rules(docs, [[(2, True, 0.5)]])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert rules.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int")) == []


def test_boosted_trees_separate_and_traverse():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    t = quality.boost(x[:1500], y[:1500])
    assert ((t.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97
    assert quality.boost(np.zeros((0, 1)), np.zeros(0)).score(np.zeros((3, 4))).tolist() == [0.5] * 3


def test_quality_of_every_row(spark, docs, rows, empty):
    labels = spark.createDataFrame([(d, 1 if d % 3 else 0, 0) for d in range(0, 70)] + [(5, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in quality.score(docs, quality.fit(empty, labels)).collect()} == {0.5}


def test_language_models_are_distributions():
    counts = {"a": Counter({"abab": 3, "ba": 1, "aab": 2}), "b": Counter({"cd": 4, "dcc": 1})}
    m = language.Model.fit(counts, 3)
    # After a seen context the probabilities of the known characters and the end add up to nearly 1.
    logs, n = m.log_prob(["ab", "cd", "zz"])
    assert n.tolist() == [3, 3, 3]
    assert logs[0, 0] > logs[0, 1] and logs[1, 1] > logs[1, 0]
    total = 0.0
    for c in "ab":
        total += np.exp(m.log_prob(["a" + c])[0][0, 0])
    assert total < 1


def test_language_of_every_row(spark, empty):
    rng = np.random.default_rng(5)
    syllables = {"en": ["th", "er", "ing", "on", "at"], "fr": ["eau", "é", "que", "les", "oi"]}
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "fr"
        rows.append((i, " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(30)), lang if i % 9 else None))
    rows += [(900, None, "en"), (901, "12 !?", "en"), (902, "", None), (903, "² ½ ①Ⅷ", "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(df)
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") and not got[i]["rejected"] for i in range(120))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (900, 901, 902, 903))
    assert language.segments("th²ing ①abc½".encode()) == ["th", "ing", "abc"]
    assert language.accepted(df, model).count() == 120
    assert {r["lang_pred"] for r in language.predict(df, language.fit(empty)).collect()} == {"und"}


def test_language_model_scores(spark, docs, rows, empty):
    small = dict(frequent=20, rounds=2, heads=64, own=24, shared=7, per_task=20)
    got = {r["doc_id"]: r for r in lm.score(docs, **small).collect()}
    count = Counter()
    for d, t, *_ in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update([*split(t, True), None])
    n, v = sum(count.values()), len(count)
    for d, t, *_ in rows:
        w, r = [*split(t, True), None], got[d]
        base = sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(count[x] > 0 for x in w), n, zlib.crc32(str(d).encode()) % 7 == 2)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9 and r["score"] < 0
    assert lm.score(empty, **small).count() == 0


def small_model(rng, block, scale=1.0):
    vec = lambda *s: (rng.standard_normal(s) * scale).astype(np.float32)
    return lm.Model(block, np.arange(32), np.arange(32), np.zeros(32), vec(32, 32), vec(32, 8), vec(32, 8), vec(32, 8), vec(2 * block), vec(8, 32), vec(32), vec(8, 2), vec(2))


def naive_log_prob(m, ids):
    """One id at a time: softmax over the positions it may look at, then over all classes."""
    total = 0.0
    for t in range(1, len(ids)):
        ask = t - 1
        low = max(0, ask // m.block * m.block - m.block)
        at = np.arange(low, ask + 1)
        s = m.k[ids[at]] @ m.q[ids[ask]] + m.near[ask - at]
        p = np.exp(s - s.max())
        mixed = (p / p.sum()) @ m.v[ids[at]]
        g = np.log(np.exp(m.table[ids[ask]].reshape(2, 16)).sum(axis=1)) + mixed @ m.group_out + m.group_bias
        c = (m.table[ids[ask]] + mixed @ m.out + m.bias).reshape(2, 16)
        k = ids[t]
        total += g[k // 16] - np.log(np.exp(g).sum()) + c[k // 16, k % 16] - np.log(np.exp(c[k // 16]).sum()) + m.in_class[k]
    return total / np.log(10)


def test_batched_windows_score_as_one_id_at_a_time():
    rng = np.random.default_rng(4)
    m = small_model(rng, 4)
    m.in_class = -rng.random(32)
    lengths = [2, 3, 5, 9, 17, 40]
    ids, first = rng.integers(0, 32, sum(lengths)), np.cumsum([0, *lengths])
    want = [naive_log_prob(m, ids[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert np.allclose(m.log_prob(ids, first), want, rtol=1e-4, atol=1e-4)


def test_attention_is_causal_and_windows_score_each_id_once():
    first = np.array([0, 40, 41 + 2, 80])
    place, valid, target = lm.window_places(first, *lm.windows(first, 16), 16)
    asked = target[target >= 0]
    assert sorted(asked.tolist()) == [k for a, b in zip(first[:-1], first[1:], strict=True) for k in range(a + 1, b)]
    assert (place[valid] < 80).all()
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 30, 40)
    m = small_model(rng, 16)
    every = [m.log_prob(np.append(ids[:20], k), np.array([0, 21]))[0] - m.log_prob(ids[:20], np.array([0, 20]))[0] for k in range(32)]
    assert abs(sum(10.0**x for x in every) - 1) < 1e-5  # the next id's probabilities add up to 1
    whole = m.log_prob(ids, np.array([0, 40]))[0]
    part = m.log_prob(ids[:25], np.array([0, 25]))[0]
    changed = ids.copy()
    changed[30:] = 3
    again = m.log_prob(changed[:25], np.array([0, 25]))[0]
    assert part == again and whole < part


def codes_of(m, ids, first):
    place, valid, target = lm.window_places(first, *lm.windows(first, m.block), m.block)
    return np.where(valid, m.code_of[ids[place]], len(m.table)), np.where(target >= 0, m.class_of[ids[np.maximum(target, 0)]], -1)


def test_training_follows_the_gradient():
    rng = np.random.default_rng(0)
    ids = np.tile([28, 1, 2, 3, 4, 5, 6, 29], 40)
    first = np.arange(0, len(ids) + 1, 8)
    m = lm.Model.start(4, 8, np.arange(32), np.arange(32), np.zeros(32), np.zeros((32, 32), np.float32))
    before, moment = m.log_prob(ids, first).sum(), None
    for _ in range(40):
        moment = lm.train(m, *codes_of(m, ids, first), 0.03, batch=16, moment=moment)
    assert m.log_prob(ids, first).sum() > before * 0.3
    # A first step of Adam moves each weight by about the rate against the sign of its gradient: as measured.
    m = small_model(rng, 4, 0.3)
    code, goal = codes_of(m, ids, first)
    for name, at in (("q", (3, 1)), ("k", (2, 5)), ("v", (5, 0)), ("near", (2,)), ("out", (1, 4)), ("group_out", (3, 0)), ("bias", (6,))):
        one, loss = small_model(np.random.default_rng(0), 4, 0.3), []
        for step in (0.02, -0.02):
            w = getattr(m, name).copy()
            kept = w.copy()
            w[at] += step
            setattr(m, name, w)
            loss.append(-m.log_prob(ids, first).sum())
            setattr(m, name, kept)
        for f in lm.WEIGHTS:
            setattr(one, f, getattr(m, f).copy())
        lm.train(one, code, goal, 0.001, batch=len(code))
        moved = float(getattr(one, name)[at] - getattr(m, name)[at])
        assert abs(loss[0] - loss[1]) < 1e-3 or (moved > 0) == (loss[0] < loss[1]), name


def test_ids_are_grouped_by_what_they_follow():
    profile = np.zeros((12, lm.BUCKETS), np.int64)
    profile[0, 0], profile[1, 1] = 1000, 900
    profile[2:6, 3], profile[6:10, 40] = 20, 10
    got = lm.classes_of(profile, own=2, shared=2)
    assert got[:2].tolist() == [0, 1] and len(set(got[2:6])) == len(set(got[6:10])) == 1 and got[2] != got[6] and set(got[10:]) == {4}


def test_empty_tables_give_no_rows(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
    assert tokens.count_tokens(empty).count() == 0
    assert rules.apply_rules(empty, rules.fit(empty, labels)).count() == 0


def naive_kneser_ney(counts, order, part):
    """Interpolated Kneser-Ney, gram by gram, with the model's conventions: counts at the highest order and at the start mark, else kinds before."""
    texts = {f"\x01{p}\x02": n for p, n in counts.items()}
    grams = [Counter() for _ in range(order + 1)]
    for t, n in texts.items():
        for size in range(1, order + 1):
            for i in range(len(t) - size + 1):
                if i + size > 1:
                    grams[size][t[i : i + size]] += n
    value = [None] * (order + 1)
    for size in range(1, order + 1):
        value[size] = {g: n if size == order or g[0] == "\x01" else max(1, len({h[0] for h in grams[size + 1] if h[1:] == g})) for g, n in grams[size].items()}
    total = 0.0
    t = f"\x01{part}\x02"
    for i in range(1, len(t)):
        p = 1 / (1 << 17)
        for size in range(1, min(order, i + 1) + 1):
            g = t[i - size + 1 : i + 1]
            v = value[size]
            n1, n2 = (sum(x == k for x in v.values()) for k in (1, 2))
            off = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            beside = [x for h, x in v.items() if h[:-1] == g[:-1]]
            if beside:
                p = max(v.get(g, 0) - off, 0) / sum(beside) + off * len(beside) / sum(beside) * p
        total += np.log(p)
    return total


def test_language_model_equals_kneser_ney_by_hand():
    counts = Counter({"abab": 3, "ba": 1, "aab": 2, "cab": 1, "abc": 1})
    m = language.Model.fit({"x": counts}, 3)
    parts = ["ab", "abab", "cba", "b", "zab"]
    got, n = m.log_prob(parts)
    assert n.tolist() == [len(p) + 1 for p in parts]
    assert np.allclose(got[:, 0], [naive_kneser_ney(counts, 3, p) for p in parts], rtol=1e-4)


def test_language_model_learns_from_every_window():
    """Each training window has its turn in one of the rounds, and none is left out."""
    from framelake.llm import lm

    rng = np.random.default_rng(1)
    first = np.concatenate([[0], np.cumsum(rng.integers(2, 400, 500))])
    ids = rng.integers(0, 49406, first[-1])
    text, start = lm.windows(first, 32)
    turn = lm._turn_of(ids, first, text, start, 3)
    counts = np.bincount(turn, minlength=3)
    assert counts.sum() == len(text) and len(counts) == 3 and counts.min() > 0.3 * len(text) and (lm._turn_of(ids, first, text, start, 1) == 0).all()


def test_every_round_of_the_language_model_takes_every_window(spark, monkeypatch):
    """A corpus of many windows is trained on as a small one is: all its windows in each round."""
    from framelake.llm import lm

    text = "the cat sat on the mat and the dog lay on the rug " * 40
    docs = spark.createDataFrame([(i, text) for i in range(300)], "doc_id bigint, text string")
    seen, one = [], lm._round
    monkeypatch.setattr(lm, "_round", lambda *a, **k: seen.append(one(*a, **k)))
    got = lm.score(docs, rounds=2, heads=64, own=24, shared=7, width=4, block=2).filter("not held_out").count()
    # 520 words of one id each, and an end: 261 windows of two.
    assert got * 261 > 60_000 and seen == [got * 261] * 2


def test_row_sums_and_empty_places():
    """Sums by number equal numpy's for numbers met once and thousands of times; a step over windows with empty places follows only what is there."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 9000):
        number, values = np.minimum(rng.zipf(1.3, n), 300), rng.standard_normal((n, 5)).astype(np.float32)
        want = np.zeros((301, 5))
        np.add.at(want, number, values.astype(float))
        assert np.allclose(lm._sum_rows(number, values, 301, few=4), want, atol=1e-3)
    m = small_model(rng, 4, 0.3)
    code, goal = codes_of(m, rng.integers(0, 32, 9), np.array([0, 9]))
    s, total, mixed, _ = m.attend(code)
    assert (s[np.broadcast_to((code == 32)[:, None, :], s.shape)] == 0).all() and np.allclose(s.sum(axis=2, keepdims=True)[total > 1e-20], total[total > 1e-20], rtol=1e-5)
    before = {n: getattr(m, n).copy() for n in lm.WEIGHTS}
    moment = lm.train(m, code, goal, 0.01)
    unseen = np.setdiff1d(np.arange(32), code)
    assert len(unseen) and all((getattr(m, n)[unseen] == before[n][unseen]).all() for n in ("q", "k", "v")) and moment["step"] == 1


def test_plain_words_have_the_tokenizers_ids():
    """Words encoded without marks between them have the ids that the tokenizer gives them alone; others too."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(_subwords.vocabulary_path())
    rng = np.random.default_rng(7)
    letters = [*"abcdeénü09.,!?-$'<|>\x01²ª日", "'s", "<|endoftext|>"]
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(3000)] + ["thea", "haga.", "éeux,12!!", "a<|endoftext|>b", "it's"]
    assert 500 < sum(_subwords._PLAIN(w) is not None for w in words) < len(words)
    start, length, flat = _subwords.lexicon(_subwords.DEFAULT_VOCABULARY).compute([w.encode() for w in words])
    assert [flat[a : a + n].tolist() for a, n in zip(start, length, strict=True)] == [tok.encode(w, add_special_tokens=False).ids for w in words]
    assert _subwords._encode_simple(*_subwords._simple(tok), ["ab", "é9."])[0].tolist() == [len(tok.encode(w, add_special_tokens=False).ids) for w in ("ab", "é9.")]
