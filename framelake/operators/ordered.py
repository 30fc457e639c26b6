"""Operators over rows ordered within a video: cuts, chunks, runs, interpolation, merging, de-duplication."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, key: str, *order: str) -> DataFrame:
    """pos from 0 in each video."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def _in(key: str):
    return Window.partitionBy(key).orderBy("pos")


def deltas(df: DataFrame, key: str, value: str) -> DataFrame:
    """delta of an array column from the frame before (zeros for the first) and its length mag."""
    w = _in(key)
    zeros = F.transform(value, lambda x: x * 0.0)
    delta = F.when(F.lag(value).over(w).isNull(), zeros).otherwise(F.zip_with(F.col(value), F.lag(value).over(w), lambda a, b: (a - b).cast("double")))
    df = df.withColumn("delta", delta)
    return df.withColumn("mag", F.sqrt(F.aggregate("delta", F.lit(0.0), lambda s, x: s + x * x)))


def scene_cuts(df: DataFrame, key: str, tests: Column) -> DataFrame:
    """is_cut: tests hold and the frame is not the first."""
    return df.withColumn("is_cut", F.coalesce(tests, F.lit(False)) & (F.col("pos") > 0))


def scene_chunks(df: DataFrame, key: str) -> DataFrame:
    """chunk_id, start, end of the runs between cuts."""
    numbered = df.withColumn("chunk_id", F.sum(F.col("is_cut").cast("int")).over(_in(key)))
    return numbered.groupBy(key, "chunk_id").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))


def runs_of(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """start, end (by ts) and length of maximal runs of rows with neighbouring pos."""
    island = df.withColumn("island", F.col("pos") - F.row_number().over(_in(key)))
    return island.groupBy(key, "island").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("frames")).drop("island")


def forced_groups(df: DataFrame, key: str, jump: int = 50) -> DataFrame:
    """group: breaks where mi leaves the diagonal through the row before by more than `jump`."""
    w = Window.partitionBy(key).orderBy("si")
    off = F.abs(F.col("mi") - (F.lag("mi").over(w) + F.col("si") - F.lag("si").over(w)))
    return df.withColumn("_b", F.coalesce((off > jump).cast("int"), F.lit(0))).withColumn("group", F.sum("_b").over(w)).drop("_b")


def interpolate(df: DataFrame, key: str, max_fill: int = 2) -> DataFrame:
    """Rows for gaps of up to max_fill missing si: mi on the line, rounded half up, sim the neighbours' mean."""
    w = Window.partitionBy(key).orderBy("si")
    nxt = df.withColumns({"nsi": F.lead("si").over(w), "nmi": F.lead("mi").over(w), "nsim": F.lead("sim").over(w)})
    span = F.col("nsi") - F.col("si")
    filled = F.when(span.between(2, max_fill + 1), F.sequence(F.lit(0), span.cast("int") - 1)).otherwise(F.array(F.lit(0)))
    out = nxt.withColumn("k", F.explode(filled))
    real = F.col("k") == 0
    line = F.floor(F.col("mi") + F.col("k") * (F.col("nmi") - F.col("mi")) / span + 0.5)
    return out.select(
        key,
        (F.col("si") + F.col("k")).alias("si"),
        F.when(real, F.col("mi")).otherwise(line).alias("mi"),
        F.when(real, F.col("sim")).otherwise((F.col("sim") + F.col("nsim")) / 2).alias("sim"),
        (~real).alias("interpolated"),
    )


def path_statistics(df: DataFrame, key: str) -> DataFrame:
    """frames, gaps, confidence and speed ratio (regression slope held to 0.1 to 8) of each path."""
    slope = F.least(F.lit(8.0), F.greatest(F.lit(0.1), F.coalesce(F.regr_slope(F.col("mi").cast("double"), F.col("si").cast("double")), F.lit(1.0))))
    return df.groupBy(key).agg(
        F.count("*").alias("frames"), (F.max("si") - F.min("si") + 1 - F.countDistinct("si")).alias("gaps"), F.avg("sim").alias("confidence"), slope.alias("speed_ratio")
    )


def rolling_average(df: DataFrame, key: str, value: str, rows: int = 50) -> DataFrame:
    return df.withColumn("rolling", F.avg(value).over(_in(key).rowsBetween(1 - rows, 0)))


def merge_adjacent(segments: DataFrame, match: str, per_ms: int = 1) -> DataFrame:
    """Segments in milliseconds, or in parts of one, per_ms each (ss, se, ms, me, conf, frames, gaps, ratio, approx), neighbours joined: clip gap from -40 to 520 and
    movie gap from -80 to five clip gaps and 2500. Each join adds the clip gap's frames (25 a second) to gaps. matchSequence, where there is one, is joined up in
    order, and bestFrameDetail is that of the surer side at each join, the earlier on ties."""
    w = Window.partitionBy(match).orderBy("ss", "se", "ms", "me", "seg_id")
    gap, movie = F.col("ss") - F.lag("se").over(w), F.col("ms") - F.lag("me").over(w)
    joins = gap.between(-40 * per_ms, 520 * per_ms) & (movie >= -80 * per_ms) & (movie <= 5 * gap + 2500 * per_ms)
    grouped = segments.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("group", F.sum("_new").over(w))
    grouped = grouped.withColumn("_between", F.when(F.col("_new") == 0, F.floor(gap * 25 / (1000 * per_ms) + 0.5)).otherwise(0).cast("bigint"))
    ordered = F.struct("ss", "se", "ms", "me", "seg_id")
    frames = F.col("frames")
    carried = []
    if "matchSequence" in segments.columns:
        parts = F.array_sort(F.collect_list(F.struct("ss", "se", "ms", "me", "seg_id", "matchSequence")))
        carried.append(F.flatten(F.transform(parts, lambda p: p["matchSequence"])).alias("matchSequence"))
    if "bestFrameDetail" in segments.columns:
        parts = F.array_sort(F.collect_list(F.struct("ss", "se", "ms", "me", "seg_id", F.col("conf").cast("double").alias("conf"), F.col("frames").cast("double").alias("frames"), F.col("bestFrameDetail").alias("d"))))
        first = F.get(parts, F.lit(0))
        start = F.struct(first["conf"].alias("conf"), first["frames"].alias("frames"), first["d"].alias("d"))

        def join(acc: Column, x: Column) -> Column:
            n = acc["frames"] + x["frames"]
            d = F.when(acc["d"].isNull() | (x["d"].isNotNull() & (acc["conf"] < x["conf"])), x["d"]).otherwise(acc["d"])
            return F.struct(((acc["conf"] * acc["frames"] + x["conf"] * x["frames"]) / n).alias("conf"), n.alias("frames"), d.alias("d"))

        carried.append(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, join)["d"].alias("bestFrameDetail"))
    return grouped.groupBy(match, "group").agg(
        F.min("ss").alias("ss"),
        F.max_by("se", ordered).alias("se"),
        F.min_by("ms", ordered).alias("ms"),
        F.max_by("me", ordered).alias("me"),
        (F.sum(F.col("conf") * frames) / F.sum(frames)).alias("conf"),
        (F.sum(F.col("ratio") * frames) / F.sum(frames)).alias("ratio"),
        F.sum(frames).alias("frames"),
        (F.sum("gaps") + F.sum("_between")).alias("gaps"),
        F.bool_or("approx").alias("approx"),
        F.count("*").alias("parts"),
        *carried,
    )


def _kept(segments: DataFrame, match: str, keep: Callable[[pd.DataFrame], np.ndarray], columns: list[str]) -> DataFrame:
    """The segments whose seg_id keep() returns for their match: one fold over a match's segments, which are as many as its clip has scenes."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        ids = keep(rows)
        return pd.DataFrame({match: pd.Series([rows[match].iloc[0]] * len(ids), dtype=object), "seg_id": ids})

    kinds = {c: segments.schema[c].dataType.simpleString() for c in (match, "seg_id")}
    kept = segments.select(match, "seg_id", *columns).groupBy(match).applyInPandas(fold, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    return segments.join(kept, [match, "seg_id"])


def drop_overlaps(segments: DataFrame, match: str, most: int = 150) -> DataFrame:
    """Greedy, by confidence (ties: earlier start, then seg_id): a segment goes if it shares more than `most` ms with one kept."""

    def keep(rows: pd.DataFrame) -> np.ndarray:
        rows = rows.assign(o=-rows["conf"]).sort_values(["o", "ss", "seg_id"])
        starts, ends, n, out = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64), 0, []
        for seg, a, e in zip(rows["seg_id"], rows["ss"].to_numpy(), rows["se"].to_numpy(), strict=True):
            if not (np.minimum(ends[:n], e) - np.maximum(starts[:n], a) > most).any():
                starts[n], ends[n] = a, e
                n += 1
                out.append(seg)
        return np.array(out)

    return _kept(segments, match, keep, ["conf", "ss", "se"])


def validate_context(segments: DataFrame, match: str, per_ms: int = 1) -> DataFrame:
    """Approximate, weak and short segments stay only beside a sure one: the last kept or the next, at 85 or more, with a movie gap of -1 to 10 s."""

    def keep(rows: pd.DataFrame) -> np.ndarray:
        rows = rows.sort_values(["ss", "seg_id"])
        conf, ms, me = (rows[c].to_numpy() for c in ("conf", "ms", "me"))
        near = lambda gap: (gap >= -1000 * per_ms) & (gap <= 10000 * per_ms)
        stays = ~rows["approx"].to_numpy(bool) | (conf >= 80) | (rows["frames"].to_numpy() >= 20) | (len(rows) <= 1)
        stays[:-1] |= (conf[1:] >= 85) & near(ms[1:] - me[:-1])
        last = -1
        for k in range(len(rows)):
            stays[k] |= last >= 0 and conf[last] >= 85 and bool(near(ms[k] - me[last]))
            last = k if stays[k] else last
        return rows["seg_id"].to_numpy()[stays]

    return _kept(segments, match, keep, ["conf", "frames", "approx", "ss", "ms", "me"])


def picture_cuts(df: DataFrame, key: str, a: list[str], a_bits: int, d: list[str], d_bits: int, magnitude: str) -> DataFrame:
    """is_cut of frames with packed hashes a, d (columns of longs) and a change of colour: under 25 % of a or under 28 % of d in common with the
    frame before, or a change over 100; a null says nothing."""
    w = _in(key)

    def alike(words: list[str], size: int) -> Column:
        off = sum((F.bit_count(F.col(c).bitwiseXOR(F.lag(c).over(w))) for c in words), F.lit(0))
        return (1 - off / size) * 100

    no = F.lit(False)
    tests = F.coalesce(alike(a, a_bits) < 25, no) | F.coalesce(alike(d, d_bits) < 28, no) | F.coalesce(F.col(magnitude) > 100, no)
    return scene_cuts(df, key, tests)


def contiguous_prefix(df: DataFrame, key: str, at: str = "pos") -> DataFrame:
    """The rows of each key from position 0 on that have no hole before them: what an ordered writer may put out."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1).filter(F.col(at) == F.col("_n")).drop("_n")


def pass_counts(segments: DataFrame, key: str, approximate: str = "approx") -> DataFrame:
    """key, sure, approximate: segments by the pass that found them."""
    return segments.groupBy(key).agg(F.count_if(~F.col(approximate)).alias("sure"), F.count_if(approximate).alias("approximate"))
