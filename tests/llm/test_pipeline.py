"""The pipeline's stages against brute force."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_run_in_order_and_take_effect(spark, sf, tmp_path):
    import duckdb

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, docs
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, sf)
        out.write.parquet(str(tmp_path / str(k)))
        seen = spark.read.parquet(str(tmp_path / str(k)))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert seen.columns == names
            counts.append(seen.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] and counts[0] == counts[1]
    # Stage 3: of each group of equal texts one is left; stage 4: no ten-word window of an item is left.
    left = spark.read.parquet(str(tmp_path / "2"))
    worded = left.filter("trim(text) <> ''")  # texts emptied by the stage before are linked with nothing
    assert worded.select("text").distinct().count() == worded.count()
    cut = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t)).split()
    windows = set()
    for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall():
        w = cut(t)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    clean = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    before = {r["doc_id"]: r["text"] for r in left.collect()}
    for d, t in before.items():
        w = cut(t)
        assert (d in clean) == (not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)))
    assert {r["doc_id"] for r in seen.select("doc_id").distinct().collect()} == set(clean)


def test_clashing_columns_pass_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).selectExpr("*", "1 as kept", "'x' as n_removed", "2 as pos")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert {"kept", "n_removed", "pos"} <= set(docs.columns)


def test_rows_go_by_their_own_text(spark, sf):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    passage = next(t for (t,) in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect() if len(t.split()) > 12)
    schema = "doc_id bigint, text string"
    rows = [(None, f"x {passage} y"), (None, words(0)), (5, passage), (5, words(1)), (6, words(2))]
    left = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, schema), sf).collect()
    assert {tuple(r) for r in left} == {(None, words(0)), (5, words(1)), (6, words(2))} and len(left) == 3
    rows = [(9, words(1)), (9, words(3)), (4, words(1)), (7, words(4)), (7, words(4)), (None, words(5)), (8, "")]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema).repartition(3), sf).collect()
    assert {tuple(r) for r in left} == {(4, words(1)), (9, words(3)), (7, words(4)), (None, words(5)), (8, "")} and len(left) == 5


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_rows():
    words = lambda k, n: " ".join(f"wort{'abcdefgh'[(i * k) % 8]}{'xyz'[i % 3]}" for i in range(n))
    rows = [(k, words(k, 60), "de", "s", 1) for k in range(1, 9)]
    rows += [(20, None, None, None, None), (21, "", "de", "s", 0), (22, " \n\t", None, "s", 3), (None, words(3, 40), "de", None, 1), (None, None, None, None, None)]
    long = " ".join("wort" + "".join("abcdefghij"[int(c)] for c in str(i)) for i in range(30_000))
    rows += [(30, long, "de", "s", 1), (1, words(1, 60), "de", "s", 1), (1, words(2, 60), "de", "s", 1), (40, "123 !?", "de", "s", 6)]
    return rows


def test_odd_rows_go_through_every_stage(spark, sf, tmp_path):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        seen = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert seen.columns == docs.columns and seen.count() <= before, name
            docs, before = seen, seen.count()
        if k == 0:
            left = [r["text"] for r in seen.collect()]
            assert None not in left and "" not in left and "123 !?" not in left and len(left) == 12  # no letters, no language
        if k == 2:
            texts = [r["text"] for r in seen.filter("doc_id is not null").collect()]
            assert len(texts) == len(set(texts))
    assert seen.filter("doc_id = 30").count() >= 1


def test_empty_table_goes_through_every_stage(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf) if docs.columns[0] == "doc_id" else docs
    assert docs.count() == 0
