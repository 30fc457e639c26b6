import numpy as np
import pytest

from framelake.operators import align


def make_video(rng, n, shots=4):
    """Frames that drift inside a shot and jump between shots; two variants."""
    rows = []
    for k in range(n):
        if k % (n // shots) == 0:
            base = rng.integers(0, 2, 256 + 480)
            colour = rng.uniform(0, 255, 48)
        base = base.copy()
        base[rng.integers(0, len(base), 6)] ^= 1
        colour = np.clip(colour + rng.normal(0, 1, 48), 0, 255)
        bits = lambda x: "".join(map(str, x))
        h, d = base[:256].reshape(16, 16), base[256:]
        v = {"hash": bits(h.ravel()), "dhash": bits(d), "fhash": bits(h[:, ::-1].ravel()), "fdhash": bits(d)}
        rows.append((k, k / 25, {"full": v, "zoom_2_0_center": v}, {"colorGrid": colour.tolist(), "skinScoreGrid": [0.5] * 16, "detailGrid": [10.0] * 16}))
    return rows


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(4)
    movie = make_video(rng, 600, shots=6)
    # 60 frames as they are, then 40 at twice the speed, then 30 that are from nowhere.
    own = make_video(rng, 30, shots=1)
    parts = movie[110:170] + movie[410:490:2] + own
    clip = [(k, k / 25, r[2], r[3]) for k, r in enumerate(parts)]
    schema = "video_id STRING, " + "frameIndex INT, timestamp DOUBLE, variants MAP<STRING, STRUCT<hash: STRING, dhash: STRING, fhash: STRING, fdhash: STRING>>, signature STRUCT<colorGrid: ARRAY<DOUBLE>, skinScoreGrid: ARRAY<DOUBLE>, detailGrid: ARRAY<DOUBLE>>"
    rows = [("movie", *r) for r in movie] + [("clip", *r) for r in clip]
    frames = spark.createDataFrame(rows, schema).cache()
    pairs = spark.createDataFrame([("m1", "clip", "movie")], "match_id STRING, clip_id STRING, movie_id STRING")
    return align.match_videos(pairs, frames)


def test_planted_stretches_are_found(planted):
    segments = sorted(planted[0].collect(), key=lambda r: r["shortStart"])
    first = segments[0]
    assert abs(first["movieStart"] - 110 / 25) <= 0.04 and abs(first["shortEnd"] - 59 / 25) <= 0.2
    assert abs(first["speedRatio"] - 1) < 0.05 and not first["isApproximate"] and first["confidence"] > 90
    fast = [s for s in segments if abs(s["movieStart"] - 410 / 25) < 0.5]
    assert fast and abs(fast[0]["speedRatio"] - 2) < 0.2


def test_foreign_stretch_is_never_sure(planted):
    segments, gaps = (x.collect() for x in planted)
    foreign = [s for s in segments if s["shortStart"] >= 99 / 25]
    assert all(s["isApproximate"] for s in foreign)
    covered = sum(s["shortEnd"] - s["shortStart"] for s in segments) + sum(g["shortEnd"] - g["shortStart"] for g in gaps)
    assert covered <= 129 / 25 + 0.01


def test_candidates_follow_the_moving_representative():
    s = np.zeros(300)
    s[[10, 50, 95, 200]] = [70, 80, 75, 90]
    assert align.candidates(s, 60) == [(200, 90.0), (50, 80.0)]


def test_gap_of_two_is_filled_and_three_is_not():
    path = align.fill_gaps([(0, 0, 90.0), (3, 3, 60.0), (7, 7, 80.0)])
    assert [p[0] for p in path] == [0, 1, 2, 3, 7] and path[1][2] == 75.0


def test_slopes_are_held_to_their_range():
    assert align.regression_slope([(0, 0, 1), (1, 100, 1), (2, 200, 1)]) == 8.0
    assert align.regression_slope([(4, 1, 1)]) == 1.0


FRAME = "video_id STRING, frameIndex INT, timestamp DOUBLE, variants MAP<STRING, STRUCT<hash: STRING, dhash: STRING, fhash: STRING, fdhash: STRING>>, signature STRUCT<colorGrid: ARRAY<DOUBLE>, skinScoreGrid: ARRAY<DOUBLE>, detailGrid: ARRAY<DOUBLE>>"


def test_matches_without_segments_or_hashes_have_no_rows(spark):
    rng = np.random.default_rng(1)
    movie = make_video(rng, 80)
    rows = [("movie", *r) for r in movie] + [("two", k, k / 25, r[2], r[3]) for k, r in enumerate(movie[10:12])] + [("blank", k, k / 25, None, None) for k in range(12)]
    rows += [("part", k, k / 25, None if k % 5 == 4 else r[2], r[3]) for k, r in enumerate(movie[22:38])]
    frames = spark.createDataFrame(rows, FRAME)
    pairs = spark.createDataFrame([(m, m, "movie") for m in ("two", "blank", "part")] + [("gone", "none", "movie")], "match_id STRING, clip_id STRING, movie_id STRING")
    segments, rest = (x.collect() for x in align.match_videos(pairs, frames))
    assert {r["match_id"] for r in segments} == {"part"} and {r["match_id"] for r in rest} >= {"two", "blank"}
    assert align.match_videos(pairs.filter("match_id = 'two'"), frames)[0].collect() == []


def test_segments_carry_their_sequence_and_detail(planted):
    segments, rest = (x.collect() for x in planted)
    used = set()
    for s in segments:
        q, d = s["matchSequence"], s["bestFrameDetail"]
        assert len(q) == s["frameCount"] and q[0]["shortTime"] == s["shortStart"] and q[-1]["shortTime"] == s["shortEnd"]
        assert d["cropRegion"] == "Full Frame" and len(d["movieHash"]) == len(d["shortHash"]) == 256 and 0 <= d["detailSim"] <= 100
        used |= {round(x["shortTime"] * 25) for x in q}
    free = {k for r in rest for k in range(round(r["shortStart"] * 25), round(r["shortEnd"] * 25) + 1)}
    assert used | free == set(range(130)) and not used & free  # a frame is in a final segment's sequence or unmatched


def test_names_of_crops():
    assert [align.crop_name(n) for n in ("full", "crop_9_16_0", "zoom_1_25_left", "zoom_2_0_center", "other")] == ["Full Frame", "9:16 Crop 1", "Zoom 1.25x Left", "Zoom 2.0x Center", "other"]


def test_joins_add_gap_frames_and_keep_the_surer_detail(spark):
    from framelake.operators import ordered

    seq = lambda t: [(t, t, 90.0)]
    det = lambda n: (n,)
    rows = [
        ("m", 1, 0, 1000, 0, 1000, 80.0, 10, 1, 1.0, False, seq(0.0), det("a")),
        ("m", 2, 1200, 2000, 1200, 2000, 90.0, 30, 0, 2.0, True, seq(1.2), det("b")),
        ("m", 3, 2040, 3000, 2040, 3000, 85.0, 5, 2, 1.0, False, seq(2.04), det("c")),
        ("m", 4, 9000, 9500, 100, 600, 70.0, 5, 0, 1.0, False, seq(9.0), det("d")),
    ]
    schema = "match_id string, seg_id bigint, ss bigint, se bigint, ms bigint, me bigint, conf double, frames bigint, gaps bigint, ratio double, approx boolean, matchSequence array<struct<shortTime: double, movieTime: double, similarity: double>>, bestFrameDetail struct<name: string>"
    got = sorted(ordered.merge_adjacent(spark.createDataFrame(rows, schema).repartition(3), "match_id").collect(), key=lambda r: r["ss"])
    first = got[0]
    assert (first["ss"], first["se"], first["me"], first["frames"], first["gaps"], first["parts"]) == (0, 3000, 3000, 45, 1 + 0 + 2 + 5 + 1, 3)
    assert [q["shortTime"] for q in first["matchSequence"]] == [0.0, 1.2, 2.04] and first["bestFrameDetail"]["name"] == "b" and first["approx"]
    assert got[1]["gaps"] == 0 and got[1]["bestFrameDetail"]["name"] == "d"


def test_odd_frames_are_packed_by_the_first(spark):
    rng = np.random.default_rng(9)
    text = lambda n: "".join(map(str, rng.integers(0, 2, n)))
    v = lambda n=100: {"hash": text(n), "dhash": text(70), "fhash": text(n), "fdhash": None}
    frames = [(2, {"zoom": v(), "full": v()}), (1, {"full": v(), "zoom": v()}), (3, {"full": v(64)}), (4, {"new": v(), "zoom": v()}), (5, {}), (6, None), (7, {"full": None, "zoom": v()})]
    schema = "video_id string, frameIndex int, timestamp double, variants map<string, struct<hash: string, dhash: string, fhash: string, fdhash: string>>, signature struct<colorGrid: array<double>, skinScoreGrid: array<double>, detailGrid: array<double>>"
    df = spark.createDataFrame([("x", k, float(k), w, None) for k, w in frames], schema)
    got = align.Video.of(align.packed(df).toPandas())
    assert got.time.tolist() == [1, 2, 3, 4, 7] and got.names == ["full", "zoom"] and (got.a_bits, got.d_bits) == (100, 70) and got.fd is None
    by = {k: w for k, w in frames if w}
    for row, k in enumerate((1, 2, 3, 4, 7)):
        for col, name in enumerate(got.names):
            for table, key, size in ((got.a, "hash", 100), (got.fa, "fhash", 100), (got.d, "dhash", 70)):
                own = (by[k].get(name) or {}).get(key) or ""
                bits = "".join(map(str, np.unpackbits(table[row, col].view(np.uint8))[:size]))
                assert bits == (own if len(own) == size else "0" * size)
    assert got.hash_of(0) == by[1]["full"]["hash"] and align.Video.of(align.packed(df.filter("frameIndex > 4 and frameIndex < 7")).toPandas()) is None


def test_a_match_may_lose_all_its_segments(spark):
    from framelake.operators import ordered

    rows = [("gone", k, 50.0, 5, True, k * 9000, k * 9000 + 100, k * 90000, k * 90000 + 100) for k in range(3)] + [("stays", 9, 90.0, 30, False, 0, 100, 0, 100)]
    df = spark.createDataFrame(rows, "match_id string, seg_id bigint, conf double, frames bigint, approx boolean, ss bigint, se bigint, ms bigint, me bigint")
    assert [r["match_id"] for r in ordered.validate_context(ordered.drop_overlaps(df, "match_id"), "match_id").collect()] == ["stays"]


def test_frames_near_walks_are_scored_once(monkeypatch):
    """Walks from all candidates ask for the same frames: each block of a clip frame's scores is made once, and equals the scores of any window."""
    rng = np.random.default_rng(9)
    movie = make_video(rng, 400, shots=4)
    videos = []
    for rows in (movie[40:80], movie):
        frame = align.pd.DataFrame([{"video_id": "v", "frameIndex": k, "timestamp": t, "variants": v, "colour": s["colorGrid"], "skin": s["skinScoreGrid"], "detail": s["detailGrid"]} for k, t, v, s in rows])
        packed = [align._pack_frame(v) for v in frame["variants"]]
        videos.append(align.Video.of(frame.assign(layout=[p[0] for p in packed], words=[p[1] for p in packed])))
    whole, asked = align.Scores.frame, []
    monkeypatch.setattr(align.Scores, "frame", lambda self, si, mi: asked.append((si, len(mi))) or whole(self, si, mi))
    assert align.align(*videos, 82, 9, 3)
    assert len(asked) <= 40 and sum(n for _, n in asked) <= 40 * 400
    monkeypatch.undo()
    monkeypatch.setattr(align, "WHOLE", 0)
    for low, high in ((0, 0), (100, 137), (120, 130), (380, 399)):
        score = align.Scores(*videos)
        assert (score.near(7, low, high) == whole(score, 7, np.arange(low, high + 1))).all()
