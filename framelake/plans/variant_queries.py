"""Queries of frames compared over all their variants, of windows around candidates, and of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import bits, display, signatures, variants
from framelake.operators import ordered, pixels, search
from framelake.plans import feature_queries as Q
from framelake.plans import search_queries as S
from framelake.plans import sequence_queries as O
from framelake.plans import views as V
from framelake.sources import catalog


def _neighbours(df: DataFrame, *columns: str) -> DataFrame:
    """Each frame beside the one before, whose columns begin with o_."""
    before = df.select((F.col("pos") + 1).alias("pos"), *[F.col(c).alias("o_" + c) for c in columns])
    return df.join(before, "pos")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.variants(spark, sf_dir).select("pos", variants.in_order(F.col("variants")).alias("v"))


def compare_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _neighbours(_packed(spark, sf_dir), "v")
    return j.select("pos", display.rounded(variants.compare_fingerprints(F.col("v"), F.col("o_v"), 64), 6).alias("sim"))


def fast_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _neighbours(_packed(spark, sf_dir), "v")
    return j.select("pos", display.rounded(variants.fast_cross(F.col("v"), F.col("o_v"), 64, 112), 6).alias("sim"))


def best_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _neighbours(_packed(spark, sf_dir), "v").select("pos", variants.best_cross(F.col("v"), F.col("o_v"), 64, 112).alias("b"))
    return j.select("pos", display.rounded("b.sim", 6).alias("sim"), F.col("b.name").alias("name"))


def frame_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of each frame and the one before by channel; every fifth frame has no signature."""
    s = V.signatures(spark, sf_dir).select("pos", signatures.normalised_colours(F.col("colour")).alias("z"), "skin", "detail").filter("pos % 5 > 0")
    j = _neighbours(_packed(spark, sf_dir), "v").join(_neighbours(s, "z", "skin", "detail"), "pos", "left")
    c = F.col
    # Frames without signatures have null shares.
    channels = (
        signatures.colour_similarity(c("z"), c("o_z")), signatures.skin_similarity(c("skin"), c("o_skin")), signatures.detail_similarity(c("detail"), c("o_detail")),
    )
    shares = [F.when(c("z").isNotNull(), x) for x in channels]
    d = j.select("pos", variants.frame_detail(c("v"), c("o_v"), *shares, 64, 112).alias("d"))
    return d.select("pos", c("d.cropRegion").alias("crop"), *[display.rounded(f"d.{n}Sim", 6).alias(n) for n in ("structure", "color", "skin", "detail")])


def raw_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of each frame and the one before, some without colours, skin or any channel, some with colours of 12 numbers."""
    none = F.array().cast("array<double>")
    p = F.col("pos")
    s = V.signatures(spark, sf_dir).select(
        "pos",
        F.when(p % 1000 >= 900, none).when(p % 1000 >= 800, F.slice("colour", 1, 12)).otherwise(F.col("colour")).alias("colour"),
        F.when((p % 1000 >= 850) & (p % 1000 < 950), none).otherwise(F.col("skin")).alias("skin"),
        F.when((p % 1000 >= 700) & (p % 1000 < 920), none).otherwise(F.col("detail")).alias("detail"),
    )
    c, j = F.col, _neighbours(s, "colour", "skin", "detail")
    return j.select("pos", display.rounded(signatures.raw_signature_similarity(c("colour"), c("skin"), c("detail"), c("o_colour"), c("o_skin"), c("o_detail")), 6).alias("sim"))


def char_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's hash against the first 60 bits of the one before, and the share of equal characters of both whole."""
    j = _neighbours(V.frames(spark, sf_dir).select("pos", "a"), "a")
    return j.select("pos", bits.char_hamming(F.col("a"), F.substring("o_a", 1, 60)).alias("distance"), display.rounded(bits.char_compare(F.col("a"), F.col("o_a")), 6).alias("percent"))


def _side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, w0 to w2: the first hash of each variant."""
    return _packed(spark, sf_dir).select("pos", *[F.get(F.get("v", F.lit(k))["a"], F.lit(0)).alias(f"w{k}") for k in range(3)])


def global_best_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each search's best frame by the mean over variants of the same name."""
    f = _side_by_side(spark, sf_dir)
    q = f.filter("pos % 100 = 0").select(F.floor(F.col("pos") / 100).cast("bigint").alias("si"), "w0", "w1", "w2")
    best = search.best_of(q, f, 192, 3)
    return best.select("si", "pos", display.rounded(F.col("agree") / 192 * 100, 6).alias("mean"))


def local_best_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within three frames of the search's nearest frame by the whole picture among each tenth and around it."""
    f = _side_by_side(spark, sf_dir)
    q = f.filter("pos % 100 = 0").select(F.floor(F.col("pos") / 100).cast("bigint").alias("si"), "w0", "w1", "w2")
    centre = search.best_of(q, f.filter("pos % 7 = 0"), 64, 1).select("si", F.col("pos").alias("centre"))
    best = search.nearest(search.around(q.join(centre, "si"), f, 192, 3, 3))
    return best.select("si", "pos", display.rounded(F.col("agree") / 192 * 100, 6).alias("mean"))


def rough_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All searches as one clip, one frame a second, against each fifth frame."""
    f = _packed(spark, sf_dir).withColumnRenamed("v", "variants")
    clip = f.filter("pos % 100 = 0 and pos > 0").select((F.col("pos") / 100).cast("bigint").alias("pos"), (F.col("pos") / 100).alias("timestamp"), "variants")
    movie = f.filter("pos % 100 <> 0").select("pos", (F.col("pos") / 25).alias("timestamp"), "variants")
    r = search.rough_match(clip, movie, 64)
    return r.select("shortStart", "shortEnd", "movieStart", "movieEnd", display.rounded("confidence", 6).alias("confidence"), "frameCount")


def seed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is fetched around each candidate: its frames within 3,000 positions."""
    w = search.within(S.seed_top8(spark, sf_dir).select("si", "rank", F.col("pos").alias("centre")), V.frames(spark, sf_dir).select("pos"), 3000)
    return w.groupBy("si", "rank").agg(F.count("*").alias("frames"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def forced_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of twelve searches whose best frames but themselves, of all frames, are good enough."""
    found = search.best_of(V.searches(spark, sf_dir), V.frames(spark, sf_dir), 64, 1, apart="src_pos")
    best = found.select(F.floor(F.col("si") / 12).alias("group"), (F.col("agree") / 64 * 100).alias("sim"))
    g = search.forced_gate(best, "group")
    return g.select("group", "frames", display.rounded("mean_best", 6).alias("mean_best"))


def pass_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.pass_counts(V.segments(spark, sf_dir), "match_id")


def cut_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.scene_cuts(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("cuts"))


def sequence_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of a path's frames, fifty positions a segment."""
    p = V.path(spark, sf_dir).groupBy("video_id", F.floor(F.col("si") / 50).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("si", F.col("sim").alias("similarity")))).alias("s"))
    return p.select("video_id", "segment", display.rounded(display.sequence_average(F.col("s")), 6).alias("average"))


def packed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.timeline(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("frames"))
    return n.select("video_id", display.packed_bytes(F.col("frames"), F.lit(13), F.lit(8), F.lit(15)).alias("bytes"))


def hash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.frames(spark, sf_dir)
    return f.select("pos", F.array_join(display.hash_grid(F.col("a"), 8), "/").alias("grid"), display.hash_prefix(F.col("a")).alias("prefix"))


def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames hashed twice, in other partitions the second time, and the pictures' fingerprints twice by the pixel worker: each frame's hash, and whether both agreed."""
    a = V.frames(spark, sf_dir).select("pos", F.col("a").alias("hash"))
    b = V.frames(spark, sf_dir).repartition(7, "pos").select("pos", F.col("a").alias("hash"))
    whole = lambda p: p.select((F.col("frameIndex") - 1).cast("bigint").alias("pos"), F.sha2(F.to_json(F.struct(F.map_entries("variants"), "signature")), 256).alias("hash"))
    grids, work = V.grids(spark, sf_dir), (pixels.fingerprinted(), pixels.FINGERPRINT)
    worker = catalog.same_hashes(whole(V.drawn(grids, *work)), whole(V.drawn(grids.repartition(5, "pos"), *work)), "pos").select("pos", F.col("same").alias("worker_same"))
    s = catalog.same_hashes(a, b, "pos", 64).join(worker, "pos").join(a, "pos")
    return s.select("pos", "hash", "hash_ok", "same", "worker_same")


_CROPS = (
    V.GRIDS
    + """, crops AS (SELECT pos, 'full' AS name, 0 AS ord, q FROM grids
    UNION ALL SELECT pos, 'crop_9_16_0', 1, list_transform(range(64), lambda k: q[k // 8 * 8 + k % 8 // 2 + 1]) FROM grids
    UNION ALL SELECT pos, 'zoom_2_0_center', 2, list_transform(range(64), lambda k: q[(k // 16 + 2) * 8 + k % 8 // 2 + 3]) FROM grids),
turned AS (SELECT *, """
    + Q._MIRROR
    + " AS m FROM crops), hv AS (SELECT pos, name, ord, "
    + f"{V._HASH.format(q='q')} AS a, {Q._DH.format(q='q')} AS d, {V._HASH.format(q='m')} AS fa, {Q._DH.format(q='m')} AS fd FROM turned)"
)
_CROSS = (
    _CROPS
    + """, pairs AS (SELECT x.pos, x.ord AS xo, y.ord AS yo, y.name, (1 - hamming(x.a, y.a) / 64.0) * 100 AS asim,
    greatest(0.55 * (1 - hamming(x.a, y.a) / 64.0) + 0.45 * (1 - hamming(x.d, y.d) / 112.0), 0.55 * (1 - hamming(x.a, y.fa) / 64.0) + 0.45 * (1 - hamming(x.d, y.fd) / 112.0)) * 100 AS sim
    FROM hv x JOIN hv y ON y.pos = x.pos - 1),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY pos ORDER BY sim DESC, xo, yo) = 1)"""
)
_MEANS = _CROPS + ", means AS (SELECT x.pos // 100 AS si, y.pos, 192 - sum(hamming(x.a, y.a)) AS agree FROM hv x JOIN hv y USING (name) WHERE x.pos % 100 = 0 {only} GROUP BY 1, 2)"
_TOP = "SELECT si, pos, round(agree / 192.0 * 100, 6) AS mean FROM means WHERE agree > 0 QUALIFY row_number() OVER (PARTITION BY si ORDER BY agree DESC, pos) = 1"
_CENTRES = """centres AS (SELECT x.pos // 100 AS si, y.pos AS centre FROM hv x JOIN hv y USING (name) WHERE name = 'full' AND x.pos % 100 = 0 AND y.pos % 7 = 0
    QUALIFY row_number() OVER (PARTITION BY x.pos ORDER BY hamming(x.a, y.a), y.pos) = 1)"""
_PARTLY = (
    Q._Z
    + """, given AS (SELECT pos, z, CASE WHEN pos % 1000 >= 900 THEN [] WHEN pos % 1000 >= 800 THEN colour[1:12] ELSE colour END AS colour,
    CASE WHEN pos % 1000 >= 850 AND pos % 1000 < 950 THEN [] ELSE skin END AS skin, CASE WHEN pos % 1000 >= 700 AND pos % 1000 < 920 THEN [] ELSE detail END AS detail FROM full_sig),
shares AS (SELECT x.pos, CASE WHEN len(x.colour) = 48 AND len(y.colour) = 48 THEN """
    + Q._colour_sim("y")
    + f" WHEN len(x.colour) > 0 AND len(x.colour) = len(y.colour) THEN 1 - {Q._mean_diff('x.colour', 'y.colour')} / 255 END AS c,"
    + f" CASE WHEN len(x.skin) > 0 AND len(x.skin) = len(y.skin) THEN 1 - {Q._mean_diff('x.skin', 'y.skin')} END AS s,"
    + f" CASE WHEN len(x.detail) > 0 AND len(x.detail) = len(y.detail) THEN {Q._detail_sim('y')} END AS d FROM given x JOIN given y ON y.pos = x.pos - 1)"
)

QUERIES = {
    f.__name__: f
    for f in (
        compare_fingerprints, fast_cross, best_cross, frame_detail, raw_signature, char_hamming, global_best_mean, local_best_mean, rough_match, seed_windows, forced_gate,
        pass_counts, cut_counts, sequence_average, packed_bytes, hash_grid, determinism,
    )
}
ORACLES = {
    "compare_fingerprints": f"WITH {_CROSS} SELECT pos, round(max(asim), 6) AS sim FROM pairs GROUP BY pos",
    "fast_cross": f"WITH {_CROSS} SELECT pos, round(max(sim), 6) AS sim FROM pairs WHERE xo = 0 GROUP BY pos",
    "best_cross": f"WITH {_CROSS} SELECT pos, round(sim, 6) AS sim, name FROM best",
    "frame_detail": f"""WITH {_CROSS}, {Q._Z.removeprefix(V.GRIDS + ', ')}, s AS (SELECT x.pos, {Q._colour_sim('y')} AS c, 1 - {Q._mean_diff('x.skin', 'y.skin')} AS k, {Q._detail_sim('y')} AS d
        FROM full_sig x JOIN full_sig y ON y.pos = x.pos - 1 WHERE x.pos % 5 > 0 AND y.pos % 5 > 0)
        SELECT pos, CASE name WHEN 'full' THEN 'Full Frame' WHEN 'crop_9_16_0' THEN '9:16 Crop 1' ELSE 'Zoom 2.0x Center' END AS crop, round(sim, 6) AS structure,
        round(coalesce(least(100, greatest(0, c * 100)), 50), 6) AS color, round(coalesce(least(100, greatest(0, k * 100)), 50), 6) AS skin, round(coalesce(least(100, greatest(0, d * 100)), 50), 6) AS detail
        FROM best LEFT JOIN s USING (pos)""",
    "raw_signature": f"""WITH {_PARTLY} SELECT pos, round(CASE WHEN c IS NULL AND s IS NULL AND d IS NULL THEN 50.0
        ELSE (coalesce(c, 0) + coalesce(s, 0) + coalesce(d, 0)) / ((c IS NOT NULL)::INT + (s IS NOT NULL)::INT + (d IS NOT NULL)::INT) * 100 END, 6) AS sim FROM shares""",
    "char_hamming": f"""WITH {V.FRAMES} SELECT x.pos, CAST(hamming(x.a[1:60], y.a[1:60]) + 4 AS INTEGER) AS distance, round((64 - hamming(x.a, y.a)) / 64.0 * 100, 6) AS percent
        FROM frames x JOIN frames y ON y.pos = x.pos - 1""",
    "global_best_mean": f"WITH {_MEANS.format(only='')} {_TOP}",
    "local_best_mean": f"WITH {_CROPS}, {_CENTRES}{_MEANS.removeprefix(_CROPS).format(only='AND EXISTS (SELECT 1 FROM centres c WHERE c.si = x.pos // 100 AND abs(y.pos - c.centre) <= 3)')} {_TOP}",
    "rough_match": f"""WITH {_CROPS}, first AS (SELECT * FROM hv WHERE pos = 100), clip AS (SELECT pos // 100 AS s FROM grids WHERE pos % 100 = 0 AND pos > 0), movie AS (SELECT pos FROM grids WHERE pos % 100 <> 0),
        s AS (SELECT y.pos, max((1 - hamming(x.a, y.a) / 64.0) * 100) AS sim FROM first x, hv y WHERE y.pos % 5 = 0 AND y.pos % 100 <> 0 GROUP BY 1),
        b AS (SELECT pos, sim FROM s WHERE sim > 0 ORDER BY sim DESC, pos LIMIT 1)
        SELECT (SELECT min(s) FROM clip) / 1.0 AS shortStart, (SELECT max(s) FROM clip) / 1.0 AS shortEnd, b.pos / 25 AS movieStart, m.pos / 25 AS movieEnd, round(b.sim, 6) AS confidence, (SELECT count(*) FROM clip) AS frameCount
        FROM b LEFT JOIN movie m ON m.pos = least((SELECT max(pos) FROM movie), b.pos + (SELECT count(*) FROM clip))""",
    "seed_windows": f"""{S._WITH}{S._KEPT}, t AS (SELECT * FROM (SELECT si, pos, CAST(row_number() OVER (PARTITION BY si ORDER BY agree DESC, pos) AS INTEGER) AS rank FROM kept) WHERE rank <= 8)
        SELECT t.si, t.rank, count(*) AS frames, min(f.pos) AS "first", max(f.pos) AS "last" FROM t JOIN frames f ON f.pos BETWEEN t.pos - 3000 AND t.pos + 3000 GROUP BY 1, 2""",
    "forced_gate": f"""WITH {V.SEARCHES}, best AS (SELECT si, max(agree) / 64.0 * 100 AS sim FROM agree WHERE agree > 0 AND pos <> si * 100 GROUP BY si)
        SELECT si // 12 AS "group", count(*) AS frames, round(avg(sim), 6) AS mean_best FROM best GROUP BY 1 HAVING count(*) >= 10 AND avg(sim) >= 65""",
    "pass_counts": f"WITH {V.SEGMENTS} SELECT match_id, count(*) FILTER (WHERE NOT approx) AS sure, count(*) FILTER (WHERE approx) AS approximate FROM segments GROUP BY 1",
    "cut_counts": f"WITH {O._CUTS} SELECT video_id, count(*) AS cuts FROM cuts WHERE is_cut GROUP BY 1",
    "sequence_average": f"WITH {V.PATH} SELECT video_id, si // 50 AS segment, round(avg(sim), 6) AS average FROM path GROUP BY 1, 2",
    "packed_bytes": f"WITH {V.TIMELINE} SELECT video_id, count(*) * (13 * 23 * 2 * 4 + 48 * 4 + 4 + 1400) AS bytes FROM timeline GROUP BY 1",
    "hash_grid": f"WITH {V.FRAMES} SELECT pos, array_to_string(list_transform(range(8), lambda k: a[k * 8 + 1 : k * 8 + 8]), '/') AS grid, a[1:48] || '…' AS prefix FROM frames",
    "determinism": f"WITH {V.FRAMES} SELECT pos, a AS hash, length(a) = 64 AS hash_ok, true AS same, true AS worker_same FROM frames",
}
