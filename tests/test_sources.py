import json
import sys

import numpy as np
import pytest

from framelake.operators import pixels
from framelake.sources import catalog, readers, video
from framelake.streaming import ingest


@pytest.fixture(scope="module")
def films(tmp_path_factory):
    folder = tmp_path_factory.mktemp("films")
    for name, n in (("a", 7), ("b", 3)):
        (folder / f"{name}.rgba").write_bytes(b"".join(pixels.synthetic(k, 32, 24) for k in range(n)) + b"cut off")
    (folder / "b.pts").write_text("0\n41708\n")
    return folder


def read(spark, folder, **options):
    spark.dataSource.register(video.RawVideo)
    r = spark.read.format("rawvideo").option("width", 32).option("height", 24)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(str(folder))


@pytest.mark.parametrize("options", [{}, {"frames_per_task": 2}, {"decoder": f"{sys.executable} -c \"import sys; sys.stdout.buffer.write(open(sys.argv[1], 'rb').read())\" {{path}}"}])
def test_raw_video_is_read_whole(spark, films, options):
    rows = sorted(read(spark, films, **options).collect())
    assert [(r["video_id"], r["frameIndex"]) for r in rows] == [("a", k) for k in range(1, 8)] + [("b", k) for k in range(1, 4)]
    assert all(bytes(r["rgba"]) == pixels.synthetic(r["frameIndex"] - 1, 32, 24) for r in rows)
    assert [r["timestamp"] for r in rows[7:]] == [0.0, 0.041708, 0.08] and rows[6]["timestamp"] == 0.24


def test_filters_reach_the_files(spark, films):
    """Frames outside the range are never read: the first ones could as well be gone."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    got = read(spark, films, filters="true").filter("video_id = 'a' and frameIndex > 2 and frameIndex <= 5")
    assert sorted((r["video_id"], r["frameIndex"]) for r in got.collect()) == [("a", 3), ("a", 4), ("a", 5)]
    r = video.FilteringReader({"path": str(films), "width": "32", "height": "24", "frames_per_task": "2"})
    left = [*r.pushFilters([video.In(("video_id",), ("a", "b")), video.GreaterThan(("frameIndex",), 2), video.LessThan(("frameIndex",), 7), video.EqualTo(("width",), 3)])]
    assert [type(f) for f in left] == [video.EqualTo] and [(p.path[-6], p.first, p.last) for p in r.partitions()] == [("a", 2, 3), ("a", 4, 5), ("b", 2, 2)]


@pytest.mark.parametrize("options", [{"frames_per_task": 2}, {"decoder": f"{sys.executable} -c \"import sys; sys.stdout.buffer.write(open(sys.argv[1], 'rb').read())\" {{path}}"}])
def test_an_extraction_goes_on_where_it_stopped(spark, films, tmp_path, options):
    """Stopped after the first four frames of one video and none of the other: what is resumed has the hashes of an uninterrupted run."""
    from framelake.streaming import store

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = str(tmp_path / "store")
    key = lambda df: sorted((r["video_id"], r["frameIndex"], str(sorted(r["variants"].items()))) for r in df.collect())
    load = lambda: read(spark, films, filters="true", **options)
    store.write_batch(pixels.fingerprints(load().filter("video_id = 'a' and frameIndex <= 4")), path, 0)
    left = video.rest(load, store.status(spark, path))
    assert sorted((r["video_id"], r["frameIndex"]) for r in left.select("video_id", "frameIndex").collect()) == [("a", 5), ("a", 6), ("a", 7), ("b", 1), ("b", 2), ("b", 3)]
    store.write_batch(pixels.fingerprints(left), path, 1)
    assert key(store.read(spark, path)) == key(pixels.fingerprints(load())) and {r["state"] for r in store.status(spark, path).collect()} == {"whole"}


def test_fingerprints_keep_given_times(spark, films):
    got = {(r["video_id"], r["frameIndex"]): r["timestamp"] for r in pixels.fingerprints(read(spark, films)).collect()}
    assert got["b", 2] == 0.041708 and got["a", 2] == 0.04 and len(got) == 10


def test_a_failing_decoder_is_an_error(spark, films):
    with pytest.raises(Exception, match="decoder ended"):
        read(spark, films, decoder="false").collect()


def test_forced_subtitles(spark):
    rgb = np.zeros((24, 32, 3), np.uint8)
    rgb[20, 4] = 255
    assert not pixels.process_subtitles(rgb)[1]
    clean, done = pixels.process_subtitles(rgb, force=True)
    assert done and clean.max() == 0


def test_lines_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\nbroken\n\n')
    (tmp_path / "b.json").write_text('{"k": 1}\n{"k"')
    got = {r["file"].rsplit("/", 1)[1]: r["lines"] for r in readers.count_lines(spark, str(tmp_path)).collect()}
    assert got == {"a.json": 3, "b.json": 2}


def test_a_video_is_deleted_alone(spark, tmp_path):
    df = spark.range(10).selectExpr("if(id < 4, 'v', 'w-1') as video_id", "if(id < 4, id, id - 4) as pos")
    path = str(tmp_path / "f")
    readers.write_frames(df, path)
    assert readers.delete_video(spark, path, "v") and not readers.delete_video(spark, path, "v")
    assert not readers.delete_video(spark, path, "../f") and not readers.delete_video(spark, path, "w*")
    assert [tuple(r) for r in readers.stored_videos(spark, path).collect()] == [("w-1", 6, 0, 5)]


def test_only_the_prefix_is_stored(spark, tmp_path):
    df = spark.createDataFrame([("v", 0), ("v", 1), ("v", 3), ("w", 1)], "video_id string, pos long")
    readers.write_prefix(df, str(tmp_path / "f"))
    assert [tuple(r) for r in readers.stored_videos(spark, str(tmp_path / "f")).collect()] == [("v", 2, 0, 1)]


def test_catalogue(spark):
    jobs = spark.createDataFrame([("a-1", "x"), ("b", "y")], "job_id string, state string")
    change = spark.createDataFrame([("b", "z"), ("c", "w")], "job_id string, state string")
    assert sorted(map(tuple, catalog.upsert(jobs, change).collect())) == [("a-1", "x"), ("b", "z"), ("c", "w")]
    assert [r["job_id"] for r in catalog.delete(jobs, "a-1").collect()] == ["b"] and catalog.delete(jobs, "a.1").count() == 2
    points = spark.createDataFrame([("f:9", 1), ("f:9", 5), (None, 9)], "checkpointKey string, updatedAt long")
    assert [r["updatedAt"] for r in catalog.find_checkpoint(points, "f", 9).collect()] == [5]
    done = catalog.progress(spark.createDataFrame([("a", 200, 50, 5.0)], "job_id string, total int, processed int, elapsed double")).collect()[0]
    assert (done["percent"], done["fps"], done["eta"]) == (25.0, 10.0, 15.0)
    ids = [r[0] for r in spark.range(5).select(catalog.new_id()).collect()]
    assert len(set(ids)) == 5 and catalog.delete(spark.createDataFrame([(i,) for i in ids], "job_id string"), ids[0]).count() == 4


def test_different_runs_differ(spark):
    a = spark.createDataFrame([(1, "01"), (2, "11"), (3, "1")], "k int, hash string")
    b = spark.createDataFrame([(1, "01"), (2, "10"), (3, "1")], "k int, hash string")
    got = {r["k"]: (r["hash_ok"], r["same"]) for r in catalog.same_hashes(a, b, "k", 2).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, True)}


def test_a_match_is_exported_whole(spark):
    s = spark.createDataFrame([("m", 2.0, 3.0, True, [(2.0, 90.0)]), ("m", 0.0, 1.0, False, [])], "match_id string, shortStart double, shortEnd double, isApproximate boolean, matchSequence array<struct<shortTime: double, similarity: double>>")
    u = spark.createDataFrame([("m", 4.0, 5.0), ("n", 0.0, 9.0)], "match_id string, shortStart double, shortEnd double")
    got = {r["match_id"]: json.loads(r["json"]) for r in readers.export_match(s, u, {"minFrames": 9}).collect()}
    assert [x["shortStart"] for x in got["m"]["segments"]] == [0.0, 2.0] and got["m"]["segments"][1]["matchSequence"][0]["similarity"] == 90.0
    assert got["m"]["matchStats"] == {"segments": 2, "sure": 1, "unmatched": 1} and got["m"]["parameters"] == {"minFrames": "9"}
    assert got["n"]["segments"] == [] and len(got["n"]["unmatched"]) == 1


def test_progress_is_reported(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.json").write_text(json.dumps({"video_id": "v", "frameIndex": k}) + "\n")
    seen = []
    listener = ingest.Progress(lambda name, rows, rate: seen.append((name, rows)))
    spark.streams.addListener(listener)
    try:
        stream = ingest.records(spark, str(src), bytes_per_trigger=40)
        q = stream.writeStream.queryName("p").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert [r for n, r in seen if n == "p" and r] == [1, 2, 3]
