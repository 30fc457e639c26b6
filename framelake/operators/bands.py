"""Matches against references of any length: the passes of operators.align as stages over blocks and bands of the reference.

A pass scores the seeds of all chunks against blocks of the reference in all tasks; each seed's scores are then folded in order to its candidates. A candidate's
path is walked in a task that holds only a zone of the reference around it: the band of three frames of the reference either way for each frame of the chunk; and, for the few
walks that ask for more, 26 (a step moves by at most 8 frames, the steepest slope, and 18, the widest look-ahead), which none can leave. Zones are two neighbouring stretches of a
power of two, 1,024 frames at least, so walks near each other share one: its frames, the clips' chunks and the scores of their frames are there once for all of them. The best path of
a chunk takes its frames from the next pass. What stays free is compared with every frame, block by block.

A task holds a block (4,096 frames) or a zone, which grows with a chunk of the clip, never with the reference. Seeds of one reference go to each of its blocks in groups of
at most about 2,048, walks in groups of chunks, so a reference that all clips are matched with makes more tasks, not larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators import align, ordered, search
from framelake.stage import Stages

BLOCK, BUCKET, GROUP = 4096, 64, 2048
#: Frames of a band either way for each frame of the chunk.
RUNGS = (3, 26)
#: The shortest half of a zone, as a power of two, and about the frames that all walks of a task may start from.
LEAST_LEVEL, WALKED = 10, 65_536
_PAYLOAD = ("frameIndex", "timestamp", "layout", "words", "colour", "skin", "detail")
_CHUNKS = "match_id string, clip_id string, movie_id string, chunk int, start int, end int, used array<int>"
_PATH = "s array<int>, m array<int>, v array<double>"
_TOLD = [p + c for p in ("c_", "m_") for c in ("first", "total", "coloured")]


def chunks_of(pairs: DataFrame, index: DataFrame, about: DataFrame) -> DataFrame:
    """match_id, clip_id, movie_id, chunk, start, end, used (none): the clips' runs between cuts, found block by block, each with the last frame of the one before."""
    clips = pairs.select(F.col("clip_id").alias("video_id")).distinct()
    block = F.floor(F.col("pos") / BLOCK).cast("int")
    near = F.when(F.pmod("pos", F.lit(BLOCK)) == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    own = index.join(clips, "video_id", "left_semi").withColumn("block", F.explode(near)).join(about, "video_id")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        v = align.Video.of(rows, r["first"], int(r["total"]), bool(r["coloured"]))
        at = np.arange(len(v.time)) + v.start
        here = at >= int(r["block"]) * BLOCK
        return pd.DataFrame({"video_id": pd.Series([r["video_id"]] * int(here.sum()), dtype=object), "pos": at[here], "is_cut": align.cuts_of(v)[here]})

    cuts = own.select("video_id", "block", "pos", *_PAYLOAD, "first", "total", "coloured").groupBy("video_id", "block").applyInPandas(run, "video_id string, pos bigint, is_cut boolean")
    runs = ordered.scene_chunks(cuts, "video_id").select(F.col("video_id").alias("clip_id"), F.col("chunk_id").cast("int").alias("chunk"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return pairs.select("match_id", "clip_id", "movie_id").join(runs, "clip_id").withColumn("used", F.array().cast("array<int>")).select(*[c.split()[0] for c in _CHUNKS.split(", ")])


def _described(rows: DataFrame, about: DataFrame, key: str, prefix: str) -> DataFrame:
    return rows.join(about.select(F.col("video_id").alias(key), *[F.col(c).alias(prefix + c) for c in ("first", "total", "coloured")]), key)


def _video(rows: pd.DataFrame, prefix: str) -> align.Video:
    r = rows.iloc[0]
    return align.Video.of(rows, r[f"{prefix}first"], int(r[f"{prefix}total"]), bool(r[f"{prefix}coloured"]))


def _beside(rows: DataFrame, frames: DataFrame, columns: list[str], key: list[str]):
    """Groups of rows (these columns) beside the frames of the same key, under identities of their own, as both may have one origin."""
    anew = lambda df, names: align.spread(df.select(*[F.col(c).alias(c) for c in (*names, *key)]), *key).groupBy(*key)
    return anew(rows, columns).cogroup(anew(frames, ["pos", *_PAYLOAD]))


def _with_blocks(asking: DataFrame, index: DataFrame, key: list[str], overlap: int) -> tuple[DataFrame, DataFrame]:
    """(asking rows at every block of their reference, the references' frames by block, each with `overlap` frames of the one before): both by movie_id, block and share; the
    rows of one reference are dealt to shares of about GROUP."""
    count = asking.groupBy("movie_id").agg(F.count("*").alias("n"), F.first("m_total").alias("m_total")).select("movie_id", "m_total", F.ceil(F.col("n") / GROUP).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64(*key), F.col("shares")).cast("int")
    rows = asking.join(count.select("movie_id", "shares"), "movie_id").withColumn("share", share)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), ((F.col("m_total") - 1) / BLOCK).cast("int"))))
    frames = index.withColumnRenamed("video_id", "movie_id").join(count, "movie_id")
    own = F.floor(F.col("pos") / BLOCK).cast("int")
    near = F.when((F.pmod("pos", F.lit(BLOCK)) >= BLOCK - overlap) & (own < ((F.col("m_total") - 1) / BLOCK).cast("int")), F.array(own, own + 1)).otherwise(F.array(own)) if overlap else F.array(own)
    frames = frames.withColumn("block", F.explode(near)).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return rows, frames


def _own_frames(rows: DataFrame, index: DataFrame, low: Column, high: Column, video: str, prefix: str) -> DataFrame:
    """rows with each frame of `video` from low to high: a band join by buckets of positions."""
    asked = rows.withColumn("_low", low).withColumn("_high", high).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / BUCKET), F.floor(F.col("_high") / BUCKET))))
    frames = index.select(F.col("video_id").alias(video), F.floor(F.col("pos") / BUCKET).alias("_bucket"), "pos", *_PAYLOAD)
    return asked.join(frames, [video, "_bucket"]).filter(F.col("pos").between(F.col("_low"), F.col("_high"))).drop("_low", "_high", "_bucket")


def _seeds(chunks: DataFrame, about: DataFrame, index: DataFrame) -> DataFrame:
    """The seeds of each chunk (place: their order) with their frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(*r[:6], place, si) for r in b.itertuples(index=False) for place, si in enumerate(align.seeds_of(r[4], r[5], set(r[6])))]
            yield pd.DataFrame(out, columns=["match_id", "clip_id", "movie_id", "chunk", "start", "end", "place", "si"])

    seeds = chunks.mapInPandas(run, _CHUNKS.replace("used array<int>", "place int, si int"))
    seeds = _described(_described(seeds, about, "clip_id", "c_"), about, "movie_id", "m_")
    return seeds.join(index.select(F.col("video_id").alias("clip_id"), F.col("pos").alias("si"), *_PAYLOAD), ["clip_id", "si"])


def _scored_seeds(seeds: DataFrame, index: DataFrame, floor: float) -> DataFrame:
    """match_id, chunk, place, si, block, at, sim: the positions (int32) of each block that reach the floor by a seed's fast score (float64)."""
    rows, frames = _with_blocks(seeds, index, ["match_id", "chunk", "place"], 0)

    def run(own: pd.DataFrame, movie: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(movie):
            block = _video(movie.assign(**{c: own[c].iloc[0] for c in _TOLD if c[0] == "m"}), "m_")
            for first, some in own.groupby("c_first", sort=False):  # seeds of one layout side by side, as if they were a video: a fast score asks for no neighbour
                score = align.Scores(align.Video.of(some.assign(pos=np.arange(len(some))), first, len(some), False), block)
                for i, r in enumerate(some[["match_id", "chunk", "place", "si", "block"]].itertuples(index=False)):
                    sim = score.fast(i, floor - 20)
                    at = np.flatnonzero(sim >= floor - 20)
                    if len(at):
                        out.append((*r, (at + block.start).astype(np.int32).tobytes(), sim[at].tobytes()))
        return pd.DataFrame(out, columns=["match_id", "chunk", "place", "si", "block", "at", "sim"]).astype({"match_id": object})

    key = ["movie_id", "block", "share"]
    both = _beside(rows, frames, ["match_id", "chunk", "place", "si", *_TOLD, *_PAYLOAD], key)
    return both.applyInPandas(run, "match_id string, chunk int, place int, si int, block int, at binary, sim binary")


def _candidates(scores: DataFrame, floor: float) -> DataFrame:
    """match_id, chunk, place, si, mi, turn: the candidates of each seed whose best is good enough, by rank. Streams over the blocks, holding one block and the best so far."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, out = None, align.Clusters(), []

        def close() -> None:
            best = found.best()
            if key is not None and best and best[0][1] >= floor - 18:
                out.extend((*key, mi, turn) for turn, (mi, _) in enumerate(best))

        for b in batches:
            for r in b.to_pylist():
                now = (r["match_id"], r["chunk"], r["place"], r["si"])
                if now != key:
                    close()
                    key, found = now, align.Clusters()
                found.add(np.frombuffer(r["at"], np.int32), np.frombuffer(r["sim"], np.float64))
        close()
        yield from pa.Table.from_pylist([dict(zip(_names, r, strict=True)) for r in out], pa.schema(_types)).to_batches()

    _types = [("match_id", pa.string()), ("chunk", pa.int32()), ("place", pa.int32()), ("si", pa.int32()), ("mi", pa.int32()), ("turn", pa.int32())]
    _names = [n for n, _ in _types]
    ordered_rows = scores.repartition("match_id", "chunk", "place").sortWithinPartitions("match_id", "chunk", "place", "block")
    return ordered_rows.mapInArrow(fold, "match_id string, chunk int, place int, si int, mi int, turn int")


def _walked(tries: DataFrame, index: DataFrame, reach: int, limits: tuple, floor: float) -> DataFrame:
    """match_id, chunk, place, turn, state (0: no path, 1: a path, 2: it asks for frames outside the zone) and the path of each candidate."""
    _, min_frames, drift = limits
    si, mi, start, end = (F.col(c) for c in ("si", "mi", "start", "end"))
    low = F.greatest(F.lit(0), mi - reach * (end - start) - align.LOOK_AHEAD_MAX - 1)
    high = F.least(F.col("m_total") - 1, mi + reach * (end - start) + align.LOOK_AHEAD_MAX)
    level = F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(high - low + 1)).cast("int"))
    placed = tries.withColumns({"level": level, "low": low.cast("int")}).withColumn("zone", F.expr("shiftright(low, level)")).drop("low")
    zones = placed.groupBy("movie_id", "level", "zone").agg(F.ceil(F.sum(end - start + 1) / WALKED).cast("int").alias("shares"))
    key, of = ["movie_id", "level", "zone", "share"], ["match_id", "chunk", "clip_id", "start", "end", "used", *_TOLD]
    placed = placed.join(zones, ["movie_id", "level", "zone"]).withColumn("share", F.pmod(F.xxhash64("match_id", "chunk"), F.col("shares")).cast("int"))
    chunks = placed.groupBy(*key, *of).agg(F.collect_list(F.struct("place", "turn", "si", "mi")).alias("walks"))
    clip = _own_frames(chunks, index, F.greatest(F.lit(0), start - 1), end, "clip_id", "c_").withColumn("walks", F.when(F.col("pos") == end, F.col("walks")))
    frames = index.withColumnRenamed("video_id", "movie_id").join(zones.select("movie_id", "level").distinct(), "movie_id").withColumn("zone", F.expr("shiftright(int(pos), level)"))
    frames = frames.withColumn("zone", F.explode(F.array("zone", F.col("zone") - 1))).join(zones, ["movie_id", "level", "zone"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def run(own: pd.DataFrame, zone: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(zone):
            movie = _video(zone.assign(**{c: own[c].iloc[0] for c in _TOLD if c[0] == "m"}), "m_")
            for (match, chunk), rows in own.groupby(["match_id", "chunk"], sort=False, dropna=False):
                r, score = rows.iloc[0], align.Scores(_video(rows, "c_"), movie)
                first, last, used = int(r["start"]), int(r["end"]), frozenset(r["used"])
                for w in next(x for x in rows["walks"] if x is not None):
                    path, state = None, 0
                    try:
                        path = align.trace(score, (int(w["si"]), int(w["mi"])), used, drift, first, last, floor)
                    except align.LeftBand:
                        state = 2
                        if reach == RUNGS[-1]:
                            raise
                    if path and len(path) >= align.enough(first, last, min_frames):
                        state = 1
                    out.append((match, chunk, w["place"], w["turn"], state, *([p[k] for p in path] if state == 1 else None for k in range(3))))
        return pd.DataFrame(out, columns=["match_id", "chunk", "place", "turn", "state", "s", "m", "v"]).astype({"match_id": object})

    return _beside(clip, frames, ["pos", *_PAYLOAD, *of, "walks"], key).applyInPandas(run, f"match_id string, chunk int, place int, turn int, state int, {_PATH}")


def _pass(chunks: DataFrame, index: DataFrame, about: DataFrame, limits: tuple, floor: float, stages: Stages) -> DataFrame:
    """match_id, chunk and the path that takes each chunk, where there is one: the longest, then the best on average, then the first tried."""
    seeds = stages.written(_seeds(chunks, about, index))
    found = stages.written(_candidates(_scored_seeds(seeds, index, floor), floor))
    tries = stages.written(
        found.join(chunks, ["match_id", "chunk"]).join(seeds.select("match_id", "chunk", "place", *_TOLD), ["match_id", "chunk", "place"])
    )
    paths, key = None, ["match_id", "chunk", "place", "turn"]
    for reach in RUNGS:
        done = stages.written(_walked(tries, index, reach, limits, floor))
        some = done.filter("state = 1")
        paths = some if paths is None else paths.unionByName(some)
        tries = stages.written(tries.join(done.filter("state = 2").select(*key), key, "left_semi"))
        if tries.isEmpty():
            break
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    order = F.struct(F.size("s"), F.round(mean, 9), -F.col("place"), -F.col("turn"))
    return stages.written(paths.groupBy("match_id", "chunk").agg(F.max_by(F.struct("s", "m", "v"), order).alias("p")).select("match_id", "chunk", "p.*"))


def _forced(chunks: DataFrame, index: DataFrame, about: DataFrame, stages: Stages) -> DataFrame:
    """match_id, chunk, part and path: what each chunk's free frames are most like, wherever it is, in groups along a diagonal."""
    free = F.array_except(F.sequence("start", "end"), "used")
    left = chunks.withColumn("free", free).filter(F.size("free") >= align.FORCED_FRAMES).drop("used")
    left = _described(_described(left, about, "clip_id", "c_"), about, "movie_id", "m_")
    asked = left.withColumn("si", F.explode("free")).drop("free")
    two = _own_frames(asked, index, F.greatest(F.lit(0), F.col("si") - 1), F.col("si"), "clip_id", "c_")  # with the frame before, for the change from it
    rows, frames = _with_blocks(two, index, ["match_id", "chunk", "si"], 1)

    def run(own: pd.DataFrame, movie: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(movie):
            r = own.iloc[0]
            block = _video(movie.assign(**{c: r[c] for c in _TOLD if c[0] == "m"}), "m_")
            here = np.arange(int(r["block"]) * BLOCK, min(int(r["m_total"]), (int(r["block"]) + 1) * BLOCK))
            for (match, chunk, si), part in own.groupby(["match_id", "chunk", "si"], sort=False, dropna=False):
                sim, mi = align.Scores(_video(part, "c_"), block).best(int(si), here)
                if mi >= 0:
                    out.append((match, chunk, si, mi, sim))
        return pd.DataFrame(out, columns=["match_id", "chunk", "si", "mi", "sim"]).astype({"match_id": object})

    key = ["movie_id", "block", "share"]
    best = _beside(rows, frames, ["match_id", "chunk", "si", "pos", *_TOLD, *_PAYLOAD], key).applyInPandas(run, "match_id string, chunk int, si int, mi int, sim double")
    best = best.groupBy("match_id", "chunk", "si").agg(F.max(F.struct("sim", (-F.col("mi")).alias("n"))).alias("b"))
    best = stages.written(best.select(F.struct("match_id", "chunk").alias("of"), "si", (-F.col("b.n")).alias("mi"), F.col("b.sim").alias("sim")))
    good = search.forced_gate(best, "of", align.FORCED_FRAMES, align.FORCED_MEAN).select("of")
    parts = ordered.forced_groups(best.join(good, "of"), "of", align.FORCED_JUMP)
    path = F.array_sort(F.collect_list(F.struct("si", "mi", "sim")))
    return parts.groupBy("of", "group").agg(path.alias("p")).select("of.match_id", "of.chunk", F.col("group").cast("int").alias("part"), F.col("p.si").alias("s"), F.col("p.mi").alias("m"), F.col("p.sim").alias("v"))


def find_segments(pairs: DataFrame, index: DataFrame, about: DataFrame, limits: tuple, stages: Stages) -> DataFrame:
    """Raw segments as of align.align, written: pass by pass, chunk by chunk."""
    chunks = stages.written(chunks_of(pairs, index, about))
    paths = None
    for k, floor in enumerate((limits[0], 40)):
        got = _pass(chunks, index, about, limits, floor, stages)
        row = got.withColumns({"pass": F.lit(k), "part": F.lit(0)})
        paths = row if paths is None else paths.unionByName(row)
        taken = chunks.join(got.select("match_id", "chunk", "s"), ["match_id", "chunk"], "left")
        chunks = stages.written(taken.withColumn("used", F.array_union("used", F.coalesce("s", F.array().cast("array<int>")))).drop("s").select(*[c.split()[0] for c in _CHUNKS.split(", ")]))
    forced = _forced(chunks, index, about, stages).withColumn("pass", F.lit(2))
    paths = paths.unionByName(forced.select(*paths.columns)).join(pairs.select("match_id", "clip_id", "movie_id"), "match_id")
    number = F.row_number().over(Window.partitionBy("match_id").orderBy("pass", "chunk", "part")) - 1
    return stages.written(_segments(stages.written(_described(_described(paths.withColumn("emit_seq", number), about, "clip_id", "c_"), about, "movie_id", "m_")), index))


def _segments(paths: DataFrame, index: DataFrame) -> DataFrame:
    """Segments of paths: times and details are fetched for the frames that they name, and those alone."""
    key = ["match_id", "emit_seq"]

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                path = list(zip(r.s, r.m, r.v, strict=True))
                ratio, end = align.path_end(path, int(r.m_total))
                top = max(path, key=lambda p: p[2])
                out.append((r.match_id, r.emit_seq, ratio, end, float(np.mean([p[2] for p in path])), len(path), path[-1][0] - path[0][0] + 1 - len(set(r.s)), top[0], top[1]))
            yield pd.DataFrame(out, columns=[*key, "speedRatio", "end", "confidence", "frameCount", "gapCount", "ts", "tm"])

    facts = paths.select(*key, "s", "m", "v", "m_total").mapInPandas(ends, "match_id string, emit_seq int, speedRatio double, end int, confidence double, frameCount int, gapCount int, ts int, tm int")
    facts = paths.drop("v").join(facts, key)
    time = lambda video, at, name: index.select(F.col("video_id").alias(video), F.col("pos").alias(at), F.col("timestamp").alias(name))
    points = paths.select(*key, "clip_id", "movie_id", F.posexplode(F.arrays_zip("s", "m", "v")).alias("k", "p")).select(*key, "clip_id", "movie_id", "k", F.col("p.s").alias("si"), F.col("p.m").alias("mi"), F.col("p.v").alias("v"))
    points = points.join(time("clip_id", "si", "st"), ["clip_id", "si"]).join(time("movie_id", "mi", "mt"), ["movie_id", "mi"])
    listed = points.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "st", "mt", "v"))).alias("q"))
    payload = lambda video, at, name: index.select(F.col("video_id").alias(video), F.col("pos").alias(at), F.struct("pos", *_PAYLOAD).alias(name))
    two = facts.join(payload("clip_id", "ts", "own"), ["clip_id", "ts"]).join(payload("movie_id", "tm", "other"), ["movie_id", "tm"])

    def details(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                one, two = (pd.DataFrame([r[c]]) for c in ("own", "other"))
                score = align.Scores(align.Video.of(one, r["c_first"], int(r["c_total"]), bool(r["c_coloured"])), align.Video.of(two, r["m_first"], int(r["m_total"]), bool(r["m_coloured"])))
                out.append(align.detail_of(score, int(r["ts"]), int(r["tm"])))
            yield pd.DataFrame({"match_id": b["match_id"].astype(object), "emit_seq": b["emit_seq"], "bestFrameDetail": out})

    detail = two.select(*key, "ts", "tm", "own", "other", *_TOLD).mapInPandas(details, f"match_id string, emit_seq int, bestFrameDetail {align.DETAIL}")
    closing = time("movie_id", "end", "movieEnd")
    out = facts.join(listed, key).join(detail, key).join(closing, ["movie_id", "end"])
    first, last = F.get("q", F.lit(0)), F.element_at("q", -1)
    return out.select(
        "match_id", "emit_seq", first["st"].alias("shortStart"), last["st"].alias("shortEnd"), first["mt"].alias("movieStart"), "movieEnd", "confidence", "frameCount",
        (F.col("pass") > 0).alias("isApproximate"), "gapCount", "speedRatio",
        F.transform("q", lambda x: F.struct(x["st"].alias("shortTime"), x["mt"].alias("movieTime"), x["v"].alias("similarity"))).alias("matchSequence"), "bestFrameDetail",
    )
