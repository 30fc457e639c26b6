"""The driver's tables as frame relations. Each view stands here once for Spark and once as a DuckDB CTE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import bits, hashing
from framelake.operators import ordered
from framelake.operators import pixels as pixels_op


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quantised():
    return F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("bigint"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, label, q: an 8 x 8 grid of whole numbers."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "label", _quantised().alias("q"))


GRIDS = "grids AS (SELECT vec_id AS pos, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 1000) AS BIGINT)) AS q FROM embeddings)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grids with a: the average hash, w0: packed."""
    g = grids(spark, sf_dir).withColumn("a", hashing.average_hash(F.col("q"), 64))
    return g.withColumn("w0", bits.pack(F.col("a"), 64)[0])


_HASH = "array_to_string(list_transform({q}, lambda x: CASE WHEN x * 64 >= list_sum({q}) THEN '1' ELSE '0' END), '')"
FRAMES = GRIDS + ", frames AS (SELECT pos, label, q, " + _HASH.format(q="q") + " AS a FROM grids)"


def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """si, src_pos, q, a, w0: every frame, each cell moved by up to 10."""
    g = grids(spark, sf_dir).select(F.col("pos").alias("si"), F.col("pos").alias("src_pos"), F.transform("q", lambda x, i: x + (F.col("pos") * 7 + i * 13) % 21 - 10).alias("q"))
    return g.withColumn("a", hashing.average_hash(F.col("q"), 64)).withColumn("w0", bits.pack(F.col("a"), 64)[0])


CLIP = (
    FRAMES
    + ", clip0 AS (SELECT pos AS si, pos AS src_pos, list_transform(q, lambda x, i: x + (pos * 7 + (i - 1) * 13) % 21 - 10) AS q FROM grids)"
    + ", clip AS (SELECT si, src_pos, q, " + _HASH.format(q="q") + " AS a FROM clip0)"
    + ", agree AS (SELECT c.si, f.pos, 64 - hamming(c.a, f.a) AS agree FROM clip c, frames f)"
)


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """si, src_pos, q, a, w0: every frame whose id is divisible by 100, as it is; si counts in hundreds."""
    f = frames(spark, sf_dir).filter("pos % 100 = 0")
    return f.select(F.floor(F.col("pos") / 100).cast("bigint").alias("si"), F.col("pos").alias("src_pos"), "q", "a", "w0")


SEARCHES = (
    FRAMES
    + ", searches AS (SELECT pos // 100 AS si, a FROM frames WHERE pos % 100 = 0)"
    + ", agree AS (SELECT c.si, f.pos, 64 - hamming(c.a, f.a) AS agree FROM searches c, frames f)"
)


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, colour (48 numbers from 0 to 255), skin (16 shares in quarters), detail (16 numbers)."""
    return signatures_of(grids(spark, sf_dir))


def signatures_of(g: DataFrame) -> DataFrame:
    colour = F.transform(F.slice("q", 1, 48), lambda x: F.pmod(x, F.lit(256)).cast("double"))
    skin = F.transform(F.slice("q", 49, 16), lambda x: F.pmod(x, F.lit(5)) / 4)
    detail = F.transform(F.slice("q", 49, 16), lambda x: F.pmod(x, F.lit(64)).cast("double"))
    return g.select("pos", colour.alias("colour"), skin.alias("skin"), detail.alias("detail"))


SIGNATURES = (
    GRIDS
    + """, signatures AS (SELECT pos, list_transform(q[1:48], lambda x: CAST(((x % 256) + 256) % 256 AS DOUBLE)) AS colour,
    list_transform(q[49:64], lambda x: CAST(((x % 5) + 5) % 5 AS DOUBLE) / 4) AS skin,
    list_transform(q[49:64], lambda x: CAST(((x % 64) + 64) % 64 AS DOUBLE)) AS detail FROM grids)"""
)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, variants: hashes of the whole grid, of its left half stretched to twice the width, and of its centre at twice the size."""
    return variants_of(grids(spark, sf_dir)).select("pos", "variants")


def variants_of(g: DataFrame) -> DataFrame:
    """g (q among its columns) with variants in place of q."""
    k = F.sequence(F.lit(0), F.lit(63))
    cut = lambda place: hashing.let(F.col("q"), lambda q: F.transform(k, lambda i: F.get(q, place(i).cast("int"))))
    row, col = (lambda i: F.floor(i / 8)), (lambda i: i % 8)
    g = g.select(
        "*", F.col("q").alias("full"), cut(lambda i: row(i) * 8 + F.floor(col(i) / 2)).alias("left"), cut(lambda i: (F.floor(i / 16) + 2) * 8 + F.floor(col(i) / 2) + 2).alias("centre")
    )
    named = F.array(*[F.struct(F.lit(name).alias("key"), F.col(c).alias("grid")) for name, c in (("full", "full"), ("crop_9_16_0", "left"), ("zoom_2_0_center", "centre"))])
    return g.withColumn("variants", F.map_from_entries(F.transform(named, lambda e: F.struct(e["key"], hashes(e["grid"]))))).drop("q", "full", "left", "centre")


def films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, q: shots of 25 frames, the first frame's grid with a little of each frame's own and a drift."""
    g = grids(spark, sf_dir).select("pos", "q")
    shot = g.filter("pos % 25 = 0").select(F.col("pos").alias("shot"), F.col("q").alias("base"))
    return g.withColumn("shot", F.col("pos") - F.col("pos") % 25).join(shot, "shot").select(
        "pos", F.transform("base", lambda x, i: x + F.floor(F.get("q", i) / 40).cast("bigint") + (F.col("pos") % 25) * (i * 7 % 5 - 2)).alias("q")
    )


def footage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(frames, pairs): references of 500 frames of the films each; clips of 32 frames in every 40, each cell moved by up to 10, every second clip mirrored. A clip is
    matched with the reference that it is from and with the one after that."""
    f = films(spark, sf_dir)
    movies = f.select(F.concat(F.lit("movie-"), F.floor(F.col("pos") / 500).cast("string")).alias("video_id"), (F.col("pos") % 500).alias("k"), "q")
    moved = F.transform("q", lambda x, i: x + (F.col("pos") * 7 + i * 13) % 21 - 10)
    number = F.floor(F.col("pos") / 40)
    clips = f.filter("pos % 40 < 32").withColumn("q", moved).select(
        F.concat(F.lit("clip-"), number.cast("string")).alias("video_id"), (F.col("pos") % 40).alias("k"), F.when(number % 2 == 1, hashing.mirror(F.col("q"), 8, 8)).otherwise(F.col("q")).alias("q")
    )
    both = movies.unionByName(clips).withColumn("pos", F.col("k"))
    level = F.transform("q", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(x / 3).cast("double") + 128)))
    signature = F.struct(
        F.slice(level, 1, 48).alias("colorGrid"), F.transform(F.slice("q", 49, 16), lambda x: F.pmod(x, F.lit(5)) / 4).alias("skinScoreGrid"), F.slice(level, 49, 16).alias("detailGrid")
    )
    frames = variants_of(both.withColumn("signature", signature)).select("video_id", F.col("k").cast("int").alias("frameIndex"), (F.col("k") / 25).alias("timestamp"), "variants", "signature")
    starts = f.filter("pos % 40 = 0").select(F.floor(F.col("pos") / 40).alias("c"), F.explode(F.array(F.floor(F.col("pos") / 500), F.floor(F.col("pos") / 500) + 1)).alias("m"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    pairs = starts.select(F.concat(name("c", "c"), name("-m", "m")).alias("match_id"), name("clip-", "c").alias("clip_id"), name("movie-", "m").alias("movie_id"))
    return frames, pairs


def hashes(grid) -> Column:
    """A grid's variant: 64 and 112 bits, and those of its mirror image."""
    flipped = hashing.mirror(grid, 8, 8)
    return F.struct(
        hashing.average_hash(grid, 64).alias("hash"), hashing.difference_hash(grid, 8, 8).alias("dhash"),
        hashing.average_hash(flipped, 64).alias("fhash"), hashing.difference_hash(flipped, 8, 8).alias("fdhash"),
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, pos, t (µs), level (whole number), value: a user's events in order."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), "event_id", "ts", F.expr("unix_micros(CAST(convert_timezone('UTC', current_timezone(), CAST(ts AS TIMESTAMP_NTZ)) AS TIMESTAMP))").alias("t"), F.floor("value").cast("bigint").alias("level"), "event_type"
    )
    return ordered.with_position(e, "video_id", "ts", "event_id").withColumn("pos", F.col("pos").cast("bigint"))


TIMELINE = """timeline AS (SELECT user_id AS video_id, event_id, ts, CAST(epoch_us(ts) AS BIGINT) AS t, CAST(floor(value) AS BIGINT) AS level, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, seg_id, ss, se, ms, me (ms), conf, frames, gaps, ratio, approx: orders as matched segments of a customer group."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 97).alias("match_id"),
        k.alias("seg_id"),
        (k % 4000 * 120).alias("ss"),
        (k % 4000 * 120 + 40 + k % 7 * 60).alias("se"),
        (k % 4000 * 130).alias("ms"),
        (k % 4000 * 130 + 40 + k % 5 * 80).alias("me"),
        (F.lit(50) + k % 50).cast("bigint").alias("conf"),
        (F.lit(3) + k % 25).cast("bigint").alias("frames"),
        (k % 3).alias("gaps"),
        (k % 4 + 1).cast("double").alias("ratio"),
        (k % 3 == 0).alias("approx"),
    )


SEGMENTS = """segments AS (SELECT o_custkey % 97 AS match_id, o_orderkey AS seg_id, o_orderkey % 4000 * 120 AS ss, o_orderkey % 4000 * 120 + 40 + o_orderkey % 7 * 60 AS se,
    o_orderkey % 4000 * 130 AS ms, o_orderkey % 4000 * 130 + 40 + o_orderkey % 5 * 80 AS me, 50 + o_orderkey % 50 AS conf, 3 + o_orderkey % 25 AS frames,
    o_orderkey % 3 AS gaps, CAST(o_orderkey % 4 + 1 AS DOUBLE) AS ratio, o_orderkey % 3 = 0 AS approx FROM orders)"""


def path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, si, mi, sim: an alignment path with gaps, from the timeline."""
    t = timeline(spark, sf_dir).filter("pos % 7 < 5 and pos % 11 <> 3")
    return t.select("video_id", F.col("pos").alias("si"), (F.col("pos") * 2 + F.col("level") % 3).alias("mi"), (F.lit(60) + F.col("level") % 40).cast("double").alias("sim"))


PATH = TIMELINE + ", path AS (SELECT video_id, pos AS si, pos * 2 + level % 3 AS mi, CAST(60 + level % 40 AS DOUBLE) AS sim FROM timeline WHERE pos % 7 < 5 AND pos % 11 <> 3)"


WIDTH, HEIGHT = 32, 18


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f, x, y, r, g, b: each frame's grid as a picture, with whole-number formulas of the place."""
    p = grids(spark, sf_dir).select(F.col("pos").alias("f"), "q", F.explode(F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))).alias("k"))
    p = p.select("f", (F.col("k") % WIDTH).alias("x"), F.floor(F.col("k") / WIDTH).cast("int").alias("y"), "q")
    cell = F.get("q", (F.floor(F.col("y") * 8 / HEIGHT) * 8 + F.floor(F.col("x") * 8 / WIDTH)).cast("int"))
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    low = lambda c: F.pmod(c, F.lit(256)).cast("bigint")
    return p.withColumn("v", cell).select("f", "x", "y", low(v + x * 31 + y * 17).alias("r"), low(v * 3 + x * 7 + y * 29).alias("g"), low(v * 7 + x * y).alias("b"))


def _pixels(name: str, width: int, height: int) -> str:
    return f"""{name} AS (SELECT pos AS f, x, y, ((v + x * 31 + y * 17) % 256 + 256) % 256 AS r, ((v * 3 + x * 7 + y * 29) % 256 + 256) % 256 AS g, ((v * 7 + x * y) % 256 + 256) % 256 AS b
    FROM (SELECT pos, x, y, q[y * 8 // {height} * 8 + x * 8 // {width} + 1] AS v FROM grids, range({width}) AS a(x), range({height}) AS b(y)))"""


PIXELS = GRIDS + ", " + _pixels("pixels", WIDTH, HEIGHT)
SQUARES = GRIDS + ", " + _pixels("squares", 16, 16)


PICTURE = "video_id string, frameIndex int, width int, height int, rgba binary"


def drawn(grids: DataFrame, work=None, kind: str = PICTURE, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """video_id, frameIndex (from 1), width, height, rgba: the grids' pictures as raw frames, or what work makes of them, where they are drawn and a few at a time."""

    def draw(batches):
        import numpy as np
        import pandas as pd

        x, y = np.arange(width)[None, :], np.arange(height)[:, None]
        for b in pixels_op.few(batches):
            out = []
            for q in b["q"]:
                v = np.asarray(q, np.int64)[y * 8 // height * 8 + x * 8 // width]
                channels = (v + x * 31 + y * 17, v * 3 + x * 7 + y * 29, v * 7 + x * y, np.full(v.shape, 255))
                out.append(np.stack([c % 256 for c in channels], axis=-1).astype(np.uint8).tobytes())
            yield pd.DataFrame({"video_id": "pictures", "frameIndex": b["pos"] + 1, "width": width, "height": height, "rgba": out})

    return grids.select("pos", "q").mapInPandas((lambda batches: work(draw(batches))) if work else draw, kind)


def pictures(spark: SparkSession, sf_dir: str, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    return drawn(grids(spark, sf_dir), width=width, height=height)
