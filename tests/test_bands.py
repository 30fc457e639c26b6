"""Matches in one task, in bands, and by the plain matcher: planted mirror, crop, grade, speed and foreign stretches with 13 different variants."""

import numpy as np
import pytest
from plain_matcher import Match, Plain

from framelake.operators import align, bands
from framelake.stage import Stages

NAMES = ["full", "crop_9_16_0", "crop_9_16_1", "crop_9_16_2", *[f"zoom_{z}_{p}" for z in ("1_25", "1_5", "2_0") for p in ("left", "center", "right")]]
VARIANTS = "variants MAP<STRING, STRUCT<hash: STRING, dhash: STRING, fhash: STRING, fdhash: STRING>>"
SIGNATURE = "signature STRUCT<colorGrid: ARRAY<DOUBLE>, skinScoreGrid: ARRAY<DOUBLE>, detailGrid: ARRAY<DOUBLE>>"
FRAME = f"video_id STRING, frameIndex INT, timestamp DOUBLE, {VARIANTS}, {SIGNATURE}"


def text(bits):
    return "".join(map(str, bits))


def film(rng, n, shot):
    """Frames as (variants, signature): each variant drifts by itself inside a shot; mirrored hashes are those of the mirrored bits."""
    out = []
    for k in range(n):
        if k % shot == 0:
            base = {v: (rng.integers(0, 2, (16, 16)), rng.integers(0, 2, 480)) for v in NAMES}
            colour, skin, detail = rng.uniform(0, 255, 48), rng.uniform(0, 1, 16), rng.uniform(0, 60, 16)
        for v in NAMES:
            h, d = (x.copy() for x in base[v])
            h.ravel()[rng.integers(0, 256, 4)] ^= 1
            d[rng.integers(0, 480, 6)] ^= 1
            base[v] = h, d
        colour = np.clip(colour + rng.normal(0, 2, 48), 0, 255)
        made = {v: {"hash": text(h.ravel()), "dhash": text(d), "fhash": text(h[:, ::-1].ravel()), "fdhash": text(d[::-1])} for v, (h, d) in base.items()}
        out.append((made, {"colorGrid": colour.tolist(), "skinScoreGrid": skin.tolist(), "detailGrid": detail.tolist()}))
    return out


def shaken(rng, frames, share):
    """A few bits of each hash off, as after another encoding."""
    flip = lambda t: text(np.array(list(t), int) ^ (rng.random(len(t)) < share))
    return [({n: {k: flip(x) for k, x in v.items()} for n, v in f[0].items()}, f[1]) for f in frames]


def mirror(frames):
    grid = lambda g, w: np.asarray(g).reshape(4, 4, w)[:, ::-1].ravel().tolist()
    turned = {"hash": "fhash", "dhash": "fdhash", "fhash": "hash", "fdhash": "dhash"}
    return [({n: {a: v[b] for a, b in turned.items()} for n, v in f[0].items()}, {"colorGrid": grid(f[1]["colorGrid"], 3), "skinScoreGrid": grid(f[1]["skinScoreGrid"], 1), "detailGrid": grid(f[1]["detailGrid"], 1)}) for f in frames]


def cropped(frames, name):
    """What one variant shows of the film is the whole picture of the clip; its own crops show nothing that the film has."""
    other = lambda v: {k: x[7:][::-1] + x[:7] for k, x in v.items()}
    return [({n: f[0][name] if n == "full" else other(f[0][n]) for n in f[0]}, f[1]) for f in frames]


def graded(frames):
    return [(f[0], {**f[1], "colorGrid": [min(255.0, 0.8 * x + 20) for x in f[1]["colorGrid"]]}) for f in frames]


def cases():
    rng = np.random.default_rng(11)
    movie = film(rng, 360, 45)
    own = film(rng, 24, 24)
    return movie, {
        "mirror": mirror(movie[60:84]),
        "crop": shaken(rng, cropped(movie[100:125], "crop_9_16_1"), 0.02),
        "grade": graded(shaken(rng, movie[150:176], 0.05)),
        "fast": shaken(rng, movie[181:223:1][::2] + [movie[225 + int(1.5 * k)] for k in range(20)], 0.02),
        "mixed": mirror(graded(movie[10:30])) + own + shaken(rng, movie[280:300], 0.12) + [movie[300]],
        "foreign": own,
        "short": movie[200:204],
        "grey": [(f[0], None if k % 3 == 0 else f[1]) for k, f in enumerate(movie[30:60])],
        "faint": shaken(rng, movie[320:345], 0.27),
    }


@pytest.fixture(scope="module")
def planted(spark):
    movie, clips = cases()
    rows = [(name, k + 1, k / 25, *f) for name, frames in (("movie", movie), *clips.items()) for k, f in enumerate(frames)]
    frames = spark.createDataFrame(rows, FRAME).repartition(3).cache()
    pairs = spark.createDataFrame([(f"m-{c}", c, "movie") for c in clips], "match_id STRING, clip_id STRING, movie_id STRING")
    return movie, clips, frames, pairs


def plain(movie, clips):
    film_ = Plain([(k / 25, *f) for k, f in enumerate(movie)])
    return {c: Match(Plain([(k / 25, *f) for k, f in enumerate(frames)]), film_).segments() for c, frames in clips.items()}


def paths(segments):
    out = {}
    for r in sorted(segments, key=lambda r: (r["match_id"], r["emit_seq"])):
        out.setdefault(r["match_id"][2:], []).append((r["isApproximate"], [(round(q["shortTime"] * 25), round(q["movieTime"] * 25), round(q["similarity"], 6)) for q in r["matchSequence"]]))
    return out


def test_one_task_and_bands_equal_the_plain_matcher(planted, monkeypatch):
    movie, clips, frames, pairs = planted
    want = {c: [(rough, [(s, m, round(v, 6)) for s, m, v in p]) for rough, p in found] for c, found in plain(movie, clips).items() if found}
    alone = align.find_segments(pairs, frames).collect()
    assert paths(alone) == want
    monkeypatch.setattr(bands, "BLOCK", 128)  # three blocks of the film
    banded = align.find_segments(pairs, frames, in_one_task=0).collect()
    assert paths(banded) == want
    key = lambda r: (r["match_id"], r["emit_seq"])
    for a, b in zip(sorted(alone, key=key), sorted(banded, key=key), strict=True):
        for c in a.asDict():
            if isinstance(a[c], float):
                assert a[c] == pytest.approx(b[c], abs=1e-9)
            else:
                assert a[c] == b[c] or c in ("matchSequence", "bestFrameDetail")
        assert a["bestFrameDetail"].asDict() == pytest.approx(b["bestFrameDetail"].asDict())


def test_planted_stretches_are_where_they_were(planted):
    movie, clips, frames, pairs = planted
    segments, rest = (x.collect() for x in align.match_videos(pairs, frames, in_one_task=100))
    first = {r["match_id"][2:]: r for r in sorted(segments, key=lambda r: -r["frameCount"])}
    for case, start in (("mirror", 60), ("crop", 100), ("grade", 150)):
        assert abs(first[case]["movieStart"] * 25 - start) <= 1 and not first[case]["isApproximate"], case
    assert first["crop"]["bestFrameDetail"]["cropRegion"] == "9:16 Crop 2"
    assert abs(first["fast"]["speedRatio"] - 1.75) < 0.05  # stretches of 2 and 1.5 times the speed, side by side, are joined
    assert all(r["isApproximate"] for r in segments if r["match_id"] == "m-foreign")
    assert not [r for r in rest if r["match_id"] == "m-mirror"]


def test_times_of_other_rates_are_kept(spark, planted):
    """At 24000/1001 frames a second, in whole microseconds, starts and ends are those of frames, and a frame is used or unmatched."""
    movie, clips, _, pairs = planted
    time = lambda k: round(k * 1001 / 24000, 6)
    rows = [(name, k, time(k), *f) for name, frames in (("movie", movie), ("mixed", clips["mixed"])) for k, f in enumerate(frames)]
    segments, rest = (x.collect() for x in align.match_videos(pairs.filter("match_id = 'm-mixed'"), spark.createDataFrame(rows, FRAME)))
    times = {time(k) for k in range(400)}
    assert segments and all(r[c] in times for r in segments for c in ("shortStart", "shortEnd", "movieStart", "movieEnd")) and all(r[c] in times for r in rest for c in ("shortStart", "shortEnd"))


def test_positions_run_through_partitions(spark, planted):
    *_, frames, pairs = planted
    videos = spark.createDataFrame([("movie",), ("crop",)], "video_id STRING")
    made = align.index_frames(frames, videos, Stages(spark))
    index, about = made.frames, made.videos
    got = index.select("video_id", "pos", "frameIndex").collect()
    assert {(r["video_id"], r["pos"], r["frameIndex"]) for r in got} == {("movie", k, k + 1) for k in range(360)} | {("crop", k, k + 1) for k in range(25)}
    assert {(r["video_id"], r["total"], r["coloured"]) for r in about.collect()} == {("movie", 360, True), ("crop", 25, True)}


def test_a_saved_index_is_read_by_bucket_and_gives_the_same(spark, planted):
    """Packed once; a match reads the buckets of its videos alone, and its join by video shuffles no frames."""
    *_, frames, pairs = planted
    align.save_index(frames, "packed_test", buckets=16)
    two = pairs.filter("clip_id in ('mirror', 'crop')")
    index = align.load_index(spark, "packed_test", two)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan doesn't tell the buckets
    plan = align.load_index(spark, "packed_test", two).frames._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    chosen = int(plan.split("SelectedBucketsCount: ")[1].split(" out of 16")[0])
    assert chosen <= 3 and "mapInPandas" not in plan and "MapInPandas" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = two.selectExpr("match_id", "movie_id as video_id").repartition(2).join(spark.table("packed_test_frames"), "video_id").explain
        import contextlib
        import io

        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            joined()
        shuffles = out.getvalue().count("Exchange hashpartitioning(video_id")
        assert shuffles == 1  # of the pairs
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    key = lambda rows: sorted((r["match_id"], r["emit_seq"], r["shortStart"], r["movieEnd"], r["confidence"], r["frameCount"]) for r in rows)
    assert key(align.find_segments(two, index).collect()) == key(align.find_segments(two, frames).collect())
    assert align.match_videos(two, align.load_index(spark, "packed_test", two, most=1))[0].count() >= 2
    for name in ("frames", "videos"):
        spark.sql(f"DROP TABLE packed_test_{name}")


def test_a_walk_that_leaves_its_band_says_so():
    rng = np.random.default_rng(0)
    movie, clips = cases()
    del rng
    import pandas as pd

    packed = lambda frames: pd.DataFrame([{"frameIndex": k, "pos": k, "timestamp": k / 25, **dict(zip(("layout", "words"), align._pack_frame(f[0]), strict=True)), "colour": f[1]["colorGrid"], "skin": f[1]["skinScoreGrid"], "detail": f[1]["detailGrid"]} for k, f in enumerate(frames)])
    rows, clip = packed(movie), align.Video.of(packed(clips["grade"]))
    layout = rows["layout"].iloc[0]
    whole = align.Scores(clip, align.Video.of(rows))
    for low, high, fits in ((0, 359, True), (120, 220, True), (155, 160, False)):
        part = align.Scores(clip, align.Video.of(rows.iloc[low : high + 1], layout, 360, True))
        if fits:
            assert align.trace(part, (5, 155), frozenset(), 3, 0, 25, 40) == align.trace(whole, (5, 155), frozenset(), 3, 0, 25, 40)
        else:
            with pytest.raises(align.LeftBand):
                align.trace(part, (5, 155), frozenset(), 3, 0, 25, 40)


def test_clusters_go_on_from_block_to_block():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 40, 5000).astype(float)
    parts = align.Clusters()
    at = np.flatnonzero(s >= 20)
    for a in range(0, 5000, 37):
        own = at[(at >= a) & (at < a + 37)]
        parts.add(own, s[own])
    kept = []
    for k in at.tolist():
        if kept and k - kept[-1][0] < 50:
            if s[k] > kept[-1][1]:
                kept[-1] = (k, s[k])
        else:
            kept.append((k, s[k]))
    assert parts.best() == sorted(kept, key=lambda c: (-c[1], c[0]))[:8] == align.candidates(s, 20)


def test_runs_are_skipped_and_nothing_is_lost():
    """Scans that open runs by what they can reach give what a scan of every frame gives, ties included, and open few frames."""
    import pandas as pd

    rng = np.random.default_rng(2)
    movie = film(rng, 900, 75)
    movie += movie[100:130]  # the same frames again: ties
    clips = {"own": shaken(rng, movie[100:112], 0.02), "foreign": film(rng, 6, 6), "bare": [(f[0], None) for f in movie[300:304]], "mirror": mirror(movie[500:506])}
    packed = lambda frames: pd.DataFrame([{"frameIndex": k, "timestamp": k / 25, **dict(zip(("layout", "words"), align._pack_frame(f[0]), strict=True)), **{n: f[1] and f[1][g] for n, g in (("colour", "colorGrid"), ("skin", "skinScoreGrid"), ("detail", "detailGrid"))}} for k, f in enumerate(frames)])
    whole = align.Video.of(packed(movie))
    for name, clip in clips.items():
        score = align.Scores(align.Video.of(packed(clip)), whole)
        for si in range(len(clip)):
            every = score.frame(si, np.arange(930))
            assert score.best(si, np.arange(930)) == (every.max(), every.argmax()), name
            assert score.best(si, np.arange(37, 700)) == (every[37:700].max(), 37 + every[37:700].argmax())
            plain_fast = score.structure(si, np.arange(930), every=False)
            for floor in (0, 62, 80):
                fast = score.fast(si, floor)
                assert (fast[plain_fast >= floor] == plain_fast[plain_fast >= floor]).all() and (fast[plain_fast < floor] < max(floor, 1e-9) + 100 * (floor == 0)).all()
    score = align.Scores(align.Video.of(packed(clips["own"])), whole)
    for si in range(12):
        score.best(si, np.arange(930))
    assert score.opened < 0.3 * score.seen


def test_walks_share_the_zones_of_their_reference(spark):
    """A group of walks is a zone of a reference, not a candidate: its frames are dealt out once for all walks in it."""
    packed = "video_id string, pos bigint, frameIndex int, timestamp double, layout string, words binary, colour array<double>, skin array<double>, detail array<double>"
    told = ", ".join(f"{p}first string, {p}total bigint, {p}coloured boolean" for p in ("c_", "m_"))
    tries = spark.createDataFrame([], f"match_id string, chunk int, place int, turn int, clip_id string, movie_id string, start int, end int, used array<int>, si int, mi int, {told}")
    walked = bands._walked(tries, spark.createDataFrame([], packed), 3, (82, 9, 3), 82)
    plan = walked._jdf.queryExecution().optimizedPlan().toString()
    assert "zone" in plan.split("FlatMapCoGroupsInPandas", 1)[1].splitlines()[0] and walked.count() == 0
