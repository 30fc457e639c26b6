"""The match queries over the whole table against the plain matcher."""

from plain_matcher import Match, Plain

from framelake.plans import match_queries
from framelake.plans import views as V


def test_matches_of_all_footage(spark, sf):
    frames, pairs = V.footage(spark, sf)
    videos = {}
    for r in frames.orderBy("video_id", "frameIndex").collect():
        variants = {n: v.asDict() for n, v in r["variants"].items()}
        videos.setdefault(r["video_id"], []).append((r["timestamp"], variants, r["signature"].asDict()))
    videos = {v: Plain(f) for v, f in videos.items()}
    want, cases = {}, pairs.collect()
    for p in cases:
        if p["movie_id"] in videos:
            found = Match(videos[p["clip_id"]], videos[p["movie_id"]]).segments()
            want[p["match_id"]] = [(rough, [(s, m, round(v, 6)) for s, m, v in path]) for rough, path in found]
    assert len(want) >= 13 and sum(map(len, want.values())) >= 13
    got = {}
    for r in sorted(match_queries.match_in_bands(spark, sf).collect(), key=lambda r: (r["match_id"], r["emit_seq"])):
        path = [(round(q["shortTime"] * 25), round(q["movieTime"] * 25), round(q["similarity"], 6)) for q in r["matchSequence"]]
        got.setdefault(r["match_id"], []).append((r["isApproximate"], path))
    assert got == {m: found for m, found in want.items() if found}
    final = match_queries.match_segments(spark, sf).collect()
    assert {r["match_id"] for r in final} == set(got)
    # Each clip's stretch of its own reference is found where it is, mirrored or not.
    for r in final:
        clip, movie = map(int, r["match_id"][1:].split("-m"))
        if movie == clip * 40 // 500 and not r["isApproximate"]:
            assert abs(r["movieStart"] - r["shortStart"] - (clip * 40 % 500) / 25) < 0.25
    assert match_queries.match_unmatched(spark, sf).columns == ["match_id", "shortStart", "shortEnd"]


def test_every_frame_is_extracted(spark, sf):
    rows = match_queries.extract_fingerprints(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count() and {r["variants"] for r in rows} == {13}
    assert len({r["hashes"] for r in rows}) > len(rows) / 2
