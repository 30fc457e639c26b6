import json

from framelake.operators import pixels
from framelake.sources import readers
from framelake.streaming import ingest, store


def record(video, k, bit):
    v = {"hash": bit * 256, "dhash": bit * 480, "fhash": bit * 256, "fdhash": bit * 480}
    return json.dumps({"video_id": video, "frameIndex": k, "timestamp": k / 25, "variants": {"full": v}})


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stored(spark, path):
    return sorted((r["video_id"], r["frameIndex"]) for r in store.read(spark, path).collect())


def test_ingest_stores_each_frame_once_and_finds_cuts(spark, tmp_path):
    spark.conf.set(*ROCKS)
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    run = lambda: store.write(ingest.records(spark, str(src)), out, cp).awaitTermination()
    (src / "a.json").write_text("\n".join(record("v", k, "0") for k in range(1, 6)) + "\nnot json\n")
    run()
    (src / "b.json").write_text("\n".join(record("v", k, "1" if k > 7 else "0") for k in range(6, 10)) + "\n" + record("a=b/c", 400, "1"))
    run()
    (src / "c.json").write_text("\n".join(record("v", k, "0") for k in range(3, 8)))  # sent again
    run()
    assert stored(spark, out) == [("a=b/c", 400)] + [("v", k) for k in range(1, 10)]
    assert sorted(r["frameIndex"] for r in readers.read_batch(spark, out, "v", 0).collect()) == list(range(1, 10))
    assert {(r["video_id"], r["frames"], r["last"], r["state"]) for r in store.status(spark, out).collect()} == {("v", 9, 9, "whole"), ("a=b/c", 1, 400, "holes")}
    (src / "c.json").unlink()
    cuts = ingest.online_cuts(ingest.records(spark, str(src), files_per_trigger=1))
    q = cuts.writeStream.format("memory").queryName("cuts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["video_id"], r["frameIndex"]) for r in spark.table("cuts").collect()] == [("v", 8)]


def frames_of(spark, video, ks):
    return spark.read.schema("video_id STRING, " + readers.FINGERPRINT).json(spark.sparkContext.parallelize([record(video, k, "0") for k in ks]))


def test_a_cut_off_batch_shows_nothing_and_a_replay_adds_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.write_batch(frames_of(spark, "v", range(1, 400)), path, 0)
    want = stored(spark, path)
    assert len(want) == 399
    # Batch 1 is lost after its data and before its manifest.
    spark_json = type(spark.range(1).write).json
    monkeypatch.setattr(type(spark.range(1).write), "json", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        store.write_batch(frames_of(spark, "v", range(390, 420)), path, 1)
    except RuntimeError:
        pass
    monkeypatch.setattr(type(spark.range(1).write), "json", spark_json)
    assert (tmp_path / "store" / "video_id=v" / "batch_index=1" / "ingest=1").exists() and stored(spark, path) == want
    # Another batch meanwhile doesn't take the lost frames for stored; the replay then adds only what is missing, and again nothing.
    store.write_batch(frames_of(spark, "v", [400, 401]), path, 2)
    for _ in range(2):
        store.write_batch(frames_of(spark, "v", range(390, 420)), path, 1)
        got = stored(spark, path)
        assert len(got) == len(set(got)) == 419 and got[-1] == ("v", 419)
    assert {(r["frames"], r["state"]) for r in store.status(spark, path).collect()} == {(419, "whole")}


def test_a_batch_reads_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    for k in range(3):
        store.write_batch(frames_of(spark, f"other{k}", [1, 301, 601]), path, k)
    for index in (0, 1):  # what lies elsewhere isn't opened: it could as well be broken
        for f in (tmp_path / "store" / "video_id=other0" / f"batch_index={index}").rglob("*.parquet"):
            f.write_bytes(b"broken")
    store.write_batch(frames_of(spark, "other0", [601, 602]), path, 3)
    m = store.manifest(spark, path).filter("ingest = 3").collect()
    assert [(r["video_id"], r["frames"], r["first"]) for r in m] == [("other0", 1, 602)]


def released(spark, src, name, cp, found, **options):
    rows = ingest.in_order(ingest.records(spark, str(src), files_per_trigger=1), **options)
    q = rows.writeStream.foreachBatch(lambda b, _: found.extend((r["video_id"], r["frameIndex"], r["is_cut"], r["missing"]) for r in b.collect())).option("checkpointLocation", str(cp)).queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()


def test_shuffled_files_are_released_as_sorted_ones(spark, tmp_path):
    """Frames of three videos in random files over many batches come out in order, each once, with the cuts of the sorted run; the state goes over a restart."""
    import random

    spark.conf.set(*ROCKS)
    random.seed(3)
    rows = [(v, k, record(v, k, "1" if k // 7 % 2 else "0")) for v in "abc" for k in range(1, 41)]
    want = None
    for name in ("sorted", "shuffled"):
        src, found = tmp_path / name, []
        src.mkdir()
        order = list(rows)
        if name == "shuffled":
            random.shuffle(order)
            order += order[:20]  # sent again
        half = len(order) // 2
        for part, lines in enumerate((order[:half], order[half:])):
            for k in range(4):
                (src / f"{part}{k}.json").write_text("\n".join(x[2] for x in lines[k::4] if name == "shuffled") or "\n".join(x[2] for x in lines[k * len(lines) // 4 : (k + 1) * len(lines) // 4]))
            released(spark, src, name, tmp_path / f"cp-{name}", found)
        for v in "abc":
            assert [f[1] for f in found if f[0] == v] == list(range(1, 41))
        want = want or sorted(found)
        assert sorted(found) == want and {f[1] for f in found if f[2]} == {7, 14, 21, 28, 35}


def test_a_hole_is_given_up_after_a_while(spark, tmp_path):
    """By a timer, so the query runs on until it is stopped."""
    import time

    spark.conf.set(*ROCKS)
    src, found = tmp_path / "in", []
    src.mkdir()

    def until(want):
        rows = ingest.in_order(ingest.records(spark, str(src), files_per_trigger=1), patience="4 seconds")
        took = lambda b, _: found.extend((r["frameIndex"], r["missing"]) for r in b.collect())
        q = rows.writeStream.foreachBatch(took).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
        began = time.time()
        while [f[0] for f in found][: len(want)] != want and time.time() - began < 60:
            time.sleep(0.2)
        time.sleep(1.5)  # the batch is committed
        failed = q.exception()
        q.stop()
        assert [f[0] for f in found][: len(want)] == want, failed

    (src / "a.json").write_text("\n".join(record("v", k, "0") for k in (1, 2, 5, 6, 9)))
    until([1, 2, 5, 6, 9])  # both holes, one after the other
    (src / "b.json").write_text("\n".join(record("v", k, "0") for k in (4, 10)))
    until([1, 2, 5, 6, 9, 10])  # 4 came too late
    assert [f[0] for f in found] == [1, 2, 5, 6, 9, 10] and {f[0]: f[1] for f in found if f[1]} == {5: 2, 9: 2}


def test_online_cuts_by_dhash_and_colour(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def frame(k, dhash, colour):
        grids = {"colorGrid": [colour] * 48, "skinScoreGrid": [0.0] * 16, "detailGrid": [0.0] * 16}
        v = {"hash": "0" * 256, "dhash": dhash * 480, "fhash": "0" * 256, "fdhash": "0" * 480}
        return json.dumps({"video_id": "v", "frameIndex": k, "timestamp": k / 25, "variants": {"full": v}, "signature": grids})

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(frame(k, "1" if k > 2 else "0", 9.0) for k in range(1, 5)))
    cuts = lambda name: ingest.online_cuts(ingest.records(spark, str(src))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    cuts("by_dhash").awaitTermination()
    assert [r["frameIndex"] for r in spark.table("by_dhash").collect()] == [3]
    # Over the restart the state has the colours: 14 in each of 48 cells is 97, 15 is 104.
    (src / "b.json").write_text("\n".join(frame(k, "1", 9.0 + (14 if k == 5 else 29)) for k in range(5, 8)))
    query = ingest.online_cuts(ingest.records(spark, str(src)))
    found = []
    q = query.writeStream.foreachBatch(lambda b, _: found.extend(r["frameIndex"] for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert found == [6]


def test_readers_take_lines_and_arrays(spark, tmp_path):
    lines, array = tmp_path / "l.json", tmp_path / "a.json"
    rows = [json.loads(record("v", k, "0")) for k in range(3)]
    lines.write_text("\n".join(map(json.dumps, rows[:2])) + "\n\n{broken\n" + json.dumps(rows[2]) + "\n")
    array.write_text(json.dumps(rows))
    for path in (lines, array):
        assert readers.read_records(spark, str(path)).filter("frameIndex is not null").count() == 3


def test_a_folder_of_both_formats_loses_no_frame(spark, tmp_path):
    rows = [json.loads(record("v", k, "0")) for k in range(1, 8)]
    (tmp_path / "a.json").write_text("\n \n" + json.dumps(rows[:3]))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, rows[3:5])) + "\n{broken\n")
    (tmp_path / "c.json").write_text("[\n" + ",\n".join(map(json.dumps, rows[5:])) + "\n]\n")
    (tmp_path / "d.json").write_text("")
    assert sorted(r["frameIndex"] for r in readers.read_records(spark, str(tmp_path)).filter("frameIndex is not null").collect()) == list(range(1, 8))


def test_malformed_records_go(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, "{broken"), (3, "nonsense"), (4, None), (5, '{"k": null}'), (6, '{"k": "x"}')], "id int, r string")
    got = readers.parse_records(df, "r", "k BIGINT")
    assert sorted((r["id"], r["r"]["k"]) for r in got.collect() if r["r"]["k"] is not None) == [(1, 5)] and {r["id"] for r in got.collect()} == {1, 5}
    assert got.schema["r"].dataType.names == ["k"]


def test_frames_are_written_by_batch(spark, tmp_path):
    df = spark.range(700).selectExpr("'v' as video_id", "id as pos", "id / 25 as timestamp")
    readers.write_frames(df, str(tmp_path / "f"))
    assert readers.read_batch(spark, str(tmp_path / "f"), "v", 2).count() == 100
    assert readers.read_batch(spark, str(tmp_path / "f"), "v", 9).count() == 0
    assert readers.frame_range(readers.read_video(spark, str(tmp_path / "f"), "v"), 295, 304).count() == 10


def test_synthetic_fingerprints_are_deterministic(spark):
    rows = [("v", k, 32, 24, bytearray(pixels.synthetic(k, 32, 24))) for k in range(1, 5)]
    df = spark.createDataFrame(rows, "video_id string, frameIndex int, width int, height int, rgba binary")
    key = lambda d: sorted((r["frameIndex"], str(r["variants"])) for r in pixels.fingerprints(d).collect())
    assert key(df) == key(df.repartition(3))
