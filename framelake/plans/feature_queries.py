"""Queries of hashes, crops, pixels, signatures and similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import bits, display, geometry, hashing, signatures
from framelake.operators import ordered, pixels
from framelake.plans import views as V


def hash_ahash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.frames(spark, sf_dir).select("pos", "a")


def hash_dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.grids(spark, sf_dir).select("pos", hashing.difference_hash(F.col("q"), 8, 8).alias("d"))


def hash_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.grids(spark, sf_dir).withColumn("m", hashing.mirror(F.col("q"), 8, 8))
    return m.select("pos", hashing.average_hash(F.col("m"), 64).alias("fa"), hashing.difference_hash(F.col("m"), 8, 8).alias("fd"))


def hash_flat_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = V.grids(spark, sf_dir).withColumn("q", F.when(F.col("pos") % 5 == 0, F.transform("q", lambda x: x % 2)).otherwise(F.col("q")))
    return g.select("pos", hashing.guarded(F.col("q"), 64, hashing.average_hash(F.col("q"), 64), 64).alias("a"))


def hash_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the neighbourhood, three times over."""
    g = V.grids(spark, sf_dir).withColumn("b", F.col("q").cast("array<double>"))
    for _ in range(3):
        g = g.withColumn("b", hashing.box_blur(F.col("b"), 8, 8))
    return g.select("pos", F.posexplode("b").alias("cell", "v")).select("pos", "cell", display.rounded("v", 6).alias("v"))


def crop_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of as many picture sizes as there are parts."""
    k = F.col("p_partkey")
    sizes = V.table(spark, sf_dir, "part").select((64 + k * 37 % 1900).cast("int").alias("w"), (64 + k * 53 % 1100).cast("int").alias("h")).distinct()
    return sizes.select("w", "h", F.inline(geometry.crop_rects(F.col("w"), F.col("h"))))


def crop_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_rects(spark, sf_dir).select("name").distinct().select("name", display.crop_label(F.col("name")).alias("label"))


def subtitle_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright pixels of each frame's lowest quarter, and whether they count: 8 at least, and a quarter of the area at most."""
    low = V.pixels(spark, sf_dir).filter("y >= 13")
    return low.groupBy("f").agg(F.count_if(F.expr("r > 180 and g > 180")).alias("bright"), F.count("*").alias("area")).withColumn("used", F.expr("bright >= 8 and bright * 4 <= area"))


def subtitle_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = V.pixels(spark, sf_dir).filter("y >= 13 and r > 180 and g > 180")
    near = mask.select("f", F.explode(F.sequence(F.greatest(F.lit(0), F.col("x") - 2), F.least(F.lit(31), F.col("x") + 2))).alias("x"), "y")
    return near.select("f", "x", F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - 2), F.least(F.lit(17), F.col("y") + 2))).alias("y")).distinct()


def subtitle_inpaint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pixels take the nearest unmasked pixel above, if there is one."""
    p = V.pixels(spark, sf_dir).join(subtitle_dilate(spark, sf_dir).withColumn("m", F.lit(True)), ["f", "x", "y"], "left")
    w = Window.partitionBy("f", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    clean = lambda c: F.coalesce(F.last(F.when(F.col("m").isNull(), F.col(c)), True).over(w), F.col(c)).alias(c)
    return p.select("f", "x", "y", clean("r"), clean("g"), clean("b"))


def signature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean colour, skin share and mean deviation of gray of each frame's 4 x 4 cells."""
    p = V.pixels(spark, sf_dir).withColumn("cell", F.floor(F.col("y") * 4 / 18) * 4 + F.floor(F.col("x") * 4 / 32)).withColumn("gray", hashing.gray(F.col("r"), F.col("g"), F.col("b")))
    mean = F.avg("gray").over(Window.partitionBy("f", "cell"))
    p = p.withColumn("off", F.abs(F.col("gray") - mean)).withColumn("skin", signatures.is_skin(F.col("r"), F.col("g"), F.col("b")).cast("int"))
    six = lambda c, name: display.rounded(F.avg(c), 6).alias(name)
    return p.groupBy("f", "cell").agg(six("r", "mean_r"), six("g", "mean_g"), six("b", "mean_b"), six("skin", "skin"), display.rounded(F.avg("off") + 1e-7, 4).alias("detail"))


def _by_picture(spark: SparkSession, sf_dir: str, size: tuple[int, int], schema: str, rows) -> DataFrame:
    """rows(f, rgb) of each picture, by the operators that extraction runs."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                out += rows(r.frameIndex - 1, np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4)[:, :, :3])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return V.drawn(V.grids(spark, sf_dir), run, schema, *size)


def pixels_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each picture: whether it has subtitles; how many pixels their widened mask has and where (by a sum), forced; sums of the channels, weighted by place, without them."""

    def rows(f, rgb):
        import numpy as np

        place = np.arange(1, rgb.shape[0] * rgb.shape[1] + 1).reshape(rgb.shape[:2])
        mask, (clean, used) = pixels.subtitle_mask(rgb, force=True), pixels.process_subtitles(rgb)
        return [(f, used, int(mask.sum()), int(place[mask].sum()), *(int((clean[:, :, c].astype(np.int64) * place).sum()) for c in range(3)))]

    return _by_picture(spark, sf_dir, (V.WIDTH, V.HEIGHT), "f bigint, used boolean, masked bigint, places bigint, r bigint, g bigint, b bigint", rows)


def pixels_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signature's cells of each picture of 16 x 16."""

    def rows(f, rgb):
        s = pixels.signature(rgb.astype(float))
        return [(f, k, *(round(v, 6) for v in s["colorGrid"][3 * k : 3 * k + 3]), round(s["skinScoreGrid"][k], 6), round(s["detailGrid"][k] + 1e-7, 4)) for k in range(16)]

    return _by_picture(spark, sf_dir, (16, 16), "f bigint, cell bigint, mean_r double, mean_g double, mean_b double, skin double, detail double", rows)


def pixel_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crops that extraction makes, of the sizes of crop_rects."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(w, h, *c) for w, h in zip(b["w"].tolist(), b["h"].tolist(), strict=True) for c in pixels.crops(w, h)]
            yield pd.DataFrame(rows, columns=["w", "h", "name", "sx", "sy", "sw", "sh"])

    return crop_rects(spark, sf_dir).select("w", "h").distinct().mapInPandas(run, "w int, h int, name string, sx int, sy int, sw int, sh int")


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame with the one before: distance and percent."""
    f = V.frames(spark, sf_dir)
    before = f.select((F.col("pos") + 1).alias("pos"), F.col("w0").alias("v0"))
    j = f.join(before, "pos")
    return j.select("pos", bits.hamming([F.col("w0")], [F.col("v0")]).alias("distance"), display.rounded(bits.similarity_percentage([F.col("w0")], [F.col("v0")], 64), 6).alias("percent"))


def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted similarity of each frame and the one before, the better of normal and mirrored."""
    g = V.frames(spark, sf_dir).withColumn("m", hashing.mirror(F.col("q"), 8, 8))
    g = g.select("pos", "a", hashing.difference_hash(F.col("q"), 8, 8).alias("d"), hashing.average_hash(F.col("m"), 64).alias("fa"), hashing.difference_hash(F.col("m"), 8, 8).alias("fd"))
    packed = g.select("pos", *[c.alias(f"{n}{k}") for n, size in (("a", 64), ("fa", 64), ("d", 112), ("fd", 112)) for k, c in enumerate(bits.pack(F.col(n), size))])
    other = packed.select((F.col("pos") - 1).alias("pos"), *[F.col(c).alias("o_" + c) for c in packed.columns if c != "pos"])
    share = lambda own, o, words, size: 1 - bits.hamming([F.col(f"{own}{k}") for k in range(words)], [F.col(f"o_{o}{k}") for k in range(words)]) / size
    sim = bits.pair_similarity(share("a", "a", 1, 64), share("d", "d", 2, 112), share("a", "fa", 1, 64), share("d", "fd", 2, 112))
    return packed.join(other, "pos").select("pos", display.rounded(sim, 6).alias("sim"))


def color_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = V.signatures(spark, sf_dir).select("pos", F.posexplode(signatures.normalised_colours(F.col("colour"))).alias("cell", "z"))
    return z.select("pos", "cell", display.rounded("z", 6).alias("z"))


def grid_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.signatures(spark, sf_dir)
    return s.select("pos", F.array_join(hashing.mirror(F.col("colour").cast("array<int>"), 4, 4, 3), ",").alias("colour"), F.array_join(hashing.mirror(F.col("detail").cast("array<int>"), 4, 4), ",").alias("detail"))


def _signature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.signatures(spark, sf_dir).select("pos", signatures.normalised_colours(F.col("colour")).alias("z"), "skin", "detail", "colour")
    s = ordered.deltas(s.withColumn("one", F.floor(F.col("pos") / 1000)), "one", "colour")
    other = s.select((F.col("pos") - 1).alias("pos"), *[F.col(c).alias("o_" + c) for c in ("z", "skin", "detail", "delta", "mag")])
    return s.join(other, "pos")


def signature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _signature_pairs(spark, sf_dir)
    c = F.col
    sim = signatures.signature_similarity(c("z"), c("skin"), c("detail"), c("o_z"), c("o_skin"), c("o_detail"))
    return p.select("pos", display.rounded(sim, 6).alias("sim"), display.rounded(100 * signatures.colour_similarity(c("z"), c("o_z")), 6).alias("colour"), display.rounded(100 * signatures.detail_similarity(c("detail"), c("o_detail")), 6).alias("detail"))


def temporal_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _signature_pairs(spark, sf_dir)
    c = F.col
    t = signatures.temporal_similarity(c("delta"), c("mag"), c("o_delta"), c("o_mag"), c("pos") % 1000, (c("pos") + 1) % 1000)
    return p.select("pos", display.rounded("mag", 6).alias("mag"), display.rounded(t, 6).alias("temporal"))


def frame_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pair_similarity(spark, sf_dir).join(signature_similarity(spark, sf_dir).select("pos", F.col("sim").alias("sig")), "pos").join(temporal_similarity(spark, sf_dir).select("pos", "temporal"), "pos")
    t = F.when(F.col("pos") % 3 > 0, F.col("temporal"))
    sig = F.when(F.col("pos") % 7 > 0, F.col("sig"))
    return s.select("pos", display.rounded(signatures.frame_similarity(F.col("sim"), sig, t), 5).alias("frame_sim"))


def picture_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of every thousand frames as a video: by the hashes and by the change of colour."""
    f = V.frames(spark, sf_dir).withColumn("d", hashing.difference_hash(F.col("q"), 8, 8))
    f = f.select("pos", "w0", *[c.alias(f"d{k}") for k, c in enumerate(bits.pack(F.col("d"), 112))])
    s = V.signatures(spark, sf_dir).withColumn("video", F.floor(F.col("pos") / 1000))
    s = ordered.deltas(s, "video", "colour").select("pos", "video", "mag").join(f, "pos").withColumns({"at": F.col("pos"), "pos": F.col("pos") % 1000})
    return ordered.picture_cuts(s, "video", ["w0"], 64, ["d0", "d1"], 112, "mag").select(F.col("at").alias("pos"), "is_cut")


def integrity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.segments(spark, sf_dir)
    score = display.integrity(F.col("conf"), F.col("frames") * 3, F.col("frames") * 2, F.col("conf") / 2)
    return s.select("seg_id", display.rounded(score, 6).alias("integrity"), display.checklist_class(F.col("conf").cast("double")).alias("class"))


_GRAY = "0.299 * r + 0.587 * g + 0.114 * b"
_DH = """array_to_string(list_concat(list_transform(range(56), lambda k: CASE WHEN {q}[k // 7 * 8 + k % 7 + 2] > {q}[k // 7 * 8 + k % 7 + 1] THEN '1' ELSE '0' END),
    list_transform(range(56), lambda k: CASE WHEN {q}[k + 9] > {q}[k + 1] THEN '1' ELSE '0' END)), '')"""
_MIRROR = "list_transform(range(64), lambda k: q[k // 8 * 8 + 7 - k % 8 + 1])"
_HASHED = (
    f"{V.FRAMES}, mirrored AS (SELECT pos, q, a, {_MIRROR} AS m FROM frames), hashed AS (SELECT pos, a, {_DH.format(q='q')} AS d, {V._HASH.format(q='m')} AS fa, {_DH.format(q='m')} AS fd FROM mirrored)"
)
_PAIR = """round(greatest(0.55 * (1 - hamming(x.a, y.a) / 64.0) + 0.45 * (1 - hamming(x.d, y.d) / 112.0), 0.55 * (1 - hamming(x.a, y.fa) / 64.0) + 0.45 * (1 - hamming(x.d, y.fd) / 112.0)) * 100, 6)"""
_Z = (
    V.SIGNATURES
    + """, cells AS (SELECT pos, unnest(range(48)) AS cell, unnest(colour) AS v FROM signatures),
stats AS (SELECT pos, cell % 3 AS c, avg(v) AS mean, greatest(stddev_pop(v), 8) AS dev FROM cells GROUP BY 1, 2),
z AS (SELECT x.pos, x.cell, (x.v - s.mean) / s.dev AS z FROM cells x JOIN stats s ON s.pos = x.pos AND s.c = x.cell % 3),
colours AS (SELECT pos, list(z ORDER BY cell) AS z FROM z GROUP BY pos),
full_sig AS (SELECT s.pos, c.z, s.skin, s.detail, s.colour FROM signatures s JOIN colours c USING (pos)),
flipped AS (SELECT pos, list_transform(range(48), lambda k: z[(k // 12 * 4 + 3 - k // 3 % 4) * 3 + k % 3 + 1]) AS z, list_transform(range(16), lambda k: skin[k // 4 * 4 + 3 - k % 4 + 1]) AS skin,
  list_transform(range(16), lambda k: detail[k // 4 * 4 + 3 - k % 4 + 1]) AS detail FROM full_sig)"""
)


def _mean_diff(a: str, b: str) -> str:
    return f"list_avg(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"


def _colour_sim(y: str) -> str:
    return f"greatest(0, 1 - {_mean_diff('x.z', y + '.z')} / 2)"


def _detail_sim(y: str) -> str:
    return f"(1 - {_mean_diff('x.detail', y + '.detail')} / greatest(1, list_max(x.detail), list_max({y}.detail)))"


def _raw_sim(y: str) -> str:
    return f"({_colour_sim(y)} + (1 - {_mean_diff('x.skin', y + '.skin')}) + {_detail_sim(y)}) / 3 * 100"


def _blurs(times: int) -> str:
    """b1 to b<times> from b0 (pos, cell, v)."""
    near = "JOIN b{0} b ON a.pos = b.pos AND abs(a.cell // 8 - b.cell // 8) <= 1 AND abs(a.cell % 8 - b.cell % 8) <= 1"
    return ", ".join(f"b{k + 1} AS (SELECT a.pos, a.cell, avg(b.v) AS v FROM b{k} a {near.format(k)} GROUP BY 1, 2)" for k in range(times))


_DELTA = (
    V.SIGNATURES
    + """, lagged AS (SELECT pos, colour, lag(colour) OVER (PARTITION BY pos // 1000 ORDER BY pos) AS before FROM signatures),
delta AS (SELECT pos, CASE WHEN before IS NULL THEN list_transform(colour, lambda v: v * 0.0) ELSE list_transform(list_zip(colour, before), lambda p: p[1] - p[2]) END AS d FROM lagged),
mags AS (SELECT pos, d, sqrt(list_sum(list_transform(d, lambda v: v * v))) AS mag FROM delta)"""
)
_TEMPORAL = """CASE WHEN x.pos % 1000 = 0 OR y.pos % 1000 = 0 THEN -1.0 WHEN x.mag < 6 AND y.mag < 6 THEN 78.0 WHEN x.mag < 6 OR y.mag < 6 THEN 38.0
  ELSE (list_sum(list_transform(list_zip(x.d, y.d), lambda p: p[1] * p[2])) / (x.mag * y.mag) + 1) / 2 * 100 END"""
_RECTS = """sizes AS (SELECT DISTINCT CAST(64 + p_partkey * 37 % 1900 AS INTEGER) AS w, CAST(64 + p_partkey * 53 % 1100 AS INTEGER) AS h FROM part),
tall AS (SELECT w, h, CAST(floor(floor(h * 9 / 16 + 0.5) / 2) * 2 AS INTEGER) AS t FROM sizes),
zooms(zoom, name) AS (VALUES (1.25, 'zoom_1_25'), (1.5, 'zoom_1_5'), (2.0, 'zoom_2_0')),
z AS (SELECT w, h, name, floor(floor(w / zoom + 0.5) / 2) * 2 AS zw, floor(floor(h / zoom + 0.5) / 2) * 2 AS zh FROM sizes, zooms),
rects AS (
  SELECT w, h, 'full' AS name, 0 AS sx, 0 AS sy, w AS sw, h AS sh FROM sizes
  UNION ALL SELECT w, h, 'crop_9_16_' || i, CASE WHEN t <= w THEN floor(floor(i * (w - t) / 4 + 0.5) / 2) * 2 ELSE 0 END, 0, CASE WHEN t <= w THEN t ELSE w END, h FROM tall, range(5) AS r(i)
  UNION ALL SELECT w, h, name || '_center', floor(floor((w - zw) / 2 + 0.5) / 2) * 2, floor(floor((h - zh) / 2 + 0.5) / 2) * 2, zw, zh FROM z
  UNION ALL SELECT w, h, name || '_left', 0, floor(floor((h - zh) / 2 + 0.5) / 2) * 2, zw, zh FROM z WHERE name <> 'zoom_2_0'
  UNION ALL SELECT w, h, name || '_right', floor((w - zw) / 2) * 2, floor(floor((h - zh) / 2 + 0.5) / 2) * 2, zw, zh FROM z WHERE name <> 'zoom_2_0')"""
_DILATED = f"""{V.PIXELS}, mask AS (SELECT f, x, y FROM pixels WHERE y >= 13 AND r > 180 AND g > 180),
dilated AS (SELECT DISTINCT m.f, m.x + dx AS x, m.y + dy AS y FROM mask m, range(-2, 3) AS a(dx), range(-2, 3) AS b(dy) WHERE m.x + dx BETWEEN 0 AND 31 AND m.y + dy BETWEEN 0 AND 17)"""

QUERIES = {
    f.__name__: f
    for f in (
        hash_ahash, hash_dhash, hash_flip, hash_flat_guard, hash_blur, crop_rects, crop_label, subtitle_mask, subtitle_dilate, subtitle_inpaint, signature_grid, pixels_subtitles, pixels_signature, pixel_crops,
        hamming_pairs, pair_similarity, color_zscore, grid_mirror, signature_similarity, temporal_similarity, frame_similarity, picture_cuts, integrity_score,
    )
}
ORACLES = {
    "hash_ahash": f"WITH {V.FRAMES} SELECT pos, a FROM frames",
    "hash_dhash": f"WITH {V.GRIDS} SELECT pos, {_DH.format(q='q')} AS d FROM grids",
    "hash_flip": f"WITH {_HASHED} SELECT pos, fa, fd FROM hashed",
    "hash_flat_guard": f"WITH {V.GRIDS}, g AS (SELECT pos, CASE WHEN pos % 5 = 0 THEN list_transform(q, lambda x: x % 2) ELSE q END AS q FROM grids)"
    f" SELECT pos, CASE WHEN list_var_pop(q) < 1 THEN repeat('0', 64) ELSE {V._HASH.format(q='q')} END AS a FROM g",
    "hash_blur": f"""WITH {V.GRIDS}, b0 AS (SELECT pos, unnest(range(64)) AS cell, CAST(unnest(q) AS DOUBLE) AS v FROM grids), {_blurs(3)}
        SELECT pos, CAST(cell AS INTEGER) AS cell, round(v, 6) AS v FROM b3""",
    "picture_cuts": f"""WITH {_HASHED}, {_DELTA.removeprefix(V.GRIDS + ', ')}, x AS (SELECT h.pos, hamming(h.a, lag(h.a) OVER w) AS da, hamming(h.d, lag(h.d) OVER w) AS dd, m.mag, h.pos % 1000 AS place
        FROM hashed h JOIN mags m USING (pos) WINDOW w AS (PARTITION BY h.pos // 1000 ORDER BY h.pos))
        SELECT pos, coalesce((1 - da / 64.0) * 100 < 25, false) OR coalesce((1 - dd / 112.0) * 100 < 28, false) OR mag > 100 AS is_cut FROM x WHERE place > 0 UNION ALL SELECT pos, false FROM x WHERE place = 0""",
    "crop_rects": f"WITH {_RECTS} SELECT w, h, name, CAST(sx AS INTEGER) AS sx, CAST(sy AS INTEGER) AS sy, CAST(sw AS INTEGER) AS sw, CAST(sh AS INTEGER) AS sh FROM rects",
    "crop_label": f"""WITH {_RECTS} SELECT DISTINCT name, CASE WHEN name = 'full' THEN 'Full Frame' WHEN name LIKE 'crop%' THEN '9:16 Crop ' || (CAST(right(name, 1) AS INTEGER) + 1)
        ELSE 'Zoom ' || split_part(name, '_', 2) || '.' || split_part(name, '_', 3) || 'x ' || upper(split_part(name, '_', 4)[1]) || split_part(name, '_', 4)[2:] END AS label FROM rects""",
    "subtitle_mask": f"WITH {V.PIXELS} SELECT *, bright >= 8 AND bright * 4 <= area AS used FROM (SELECT f, count(*) FILTER (WHERE r > 180 AND g > 180) AS bright, count(*) AS area FROM pixels WHERE y >= 13 GROUP BY f)",
    "subtitle_dilate": f"WITH {_DILATED} SELECT f, x, y FROM dilated",
    "subtitle_inpaint": f"""WITH {_DILATED}, m AS (SELECT p.*, d.f IS NOT NULL AS masked FROM pixels p LEFT JOIN dilated d USING (f, x, y))
        SELECT a.f, a.x, a.y, coalesce(b.r, a.r) AS r, coalesce(b.g, a.g) AS g, coalesce(b.b, a.b) AS b FROM m a
        LEFT JOIN m b ON b.f = a.f AND b.x = a.x AND b.y = (SELECT max(c.y) FROM m c WHERE c.f = a.f AND c.x = a.x AND c.y <= a.y AND NOT c.masked)""",
    "pixels_subtitles": f"""WITH {_DILATED}, low AS (SELECT f, count(*) FILTER (WHERE r > 180 AND g > 180) AS bright, count(*) AS area FROM pixels WHERE y >= 13 GROUP BY f),
        m AS (SELECT p.*, d.f IS NOT NULL AS masked FROM pixels p LEFT JOIN dilated d USING (f, x, y)),
        src AS (SELECT *, max(CASE WHEN NOT masked THEN y END) OVER (PARTITION BY f, x ORDER BY y) AS up FROM m),
        c AS (SELECT a.f, a.x, a.y, a.masked, w.bright >= 8 AND w.bright * 4 <= w.area AS used, a.r, a.g, a.b, b.r AS br, b.g AS bg, b.b AS bb
              FROM src a LEFT JOIN pixels b ON b.f = a.f AND b.x = a.x AND b.y = a.up JOIN low w ON w.f = a.f)
        SELECT f, bool_or(used) AS used, count(*) FILTER (WHERE masked) AS masked, CAST(coalesce(sum(y * 32 + x + 1) FILTER (WHERE masked), 0) AS BIGINT) AS places,
        CAST(sum(CASE WHEN used THEN coalesce(br, r) ELSE r END * (y * 32 + x + 1)) AS BIGINT) AS r, CAST(sum(CASE WHEN used THEN coalesce(bg, g) ELSE g END * (y * 32 + x + 1)) AS BIGINT) AS g,
        CAST(sum(CASE WHEN used THEN coalesce(bb, b) ELSE b END * (y * 32 + x + 1)) AS BIGINT) AS b FROM c GROUP BY f""",
    "pixels_signature": f"""WITH {V.SQUARES}, p AS (SELECT *, {_GRAY} AS gray, y // 4 * 4 + x // 4 AS cell FROM squares), o AS (SELECT *, abs(gray - avg(gray) OVER (PARTITION BY f, cell)) AS off FROM p)
        SELECT f, cell, round(avg(r), 6) AS mean_r, round(avg(g), 6) AS mean_g, round(avg(b), 6) AS mean_b,
        round(avg(CASE WHEN r > 80 AND g > 40 AND b > 20 AND r > g AND r > b AND r - b > 20 THEN 1 ELSE 0 END), 6) AS skin, round(avg(off) + 1e-7, 4) AS detail FROM o GROUP BY f, cell""",
    "signature_grid": f"""WITH {V.PIXELS}, p AS (SELECT *, {_GRAY} AS gray, y * 4 // 18 * 4 + x * 4 // 32 AS cell FROM pixels),
        o AS (SELECT *, abs(gray - avg(gray) OVER (PARTITION BY f, cell)) AS off FROM p)
        SELECT f, cell, round(avg(r), 6) AS mean_r, round(avg(g), 6) AS mean_g, round(avg(b), 6) AS mean_b,
        round(avg(CASE WHEN r > 80 AND g > 40 AND b > 20 AND r > g AND r > b AND r - b > 20 THEN 1 ELSE 0 END), 6) AS skin, round(avg(off) + 1e-7, 4) AS detail FROM o GROUP BY f, cell""",
    "hamming_pairs": f"WITH {V.FRAMES} SELECT x.pos, CAST(hamming(x.a, y.a) AS INTEGER) AS distance, round((1 - hamming(x.a, y.a) / 64.0) * 100, 6) AS percent FROM frames x JOIN frames y ON y.pos = x.pos - 1",
    "pair_similarity": f"WITH {_HASHED} SELECT x.pos, {_PAIR} AS sim FROM hashed x JOIN hashed y ON y.pos = x.pos + 1",
    "color_zscore": f"WITH {_Z} SELECT pos, CAST(cell AS INTEGER) AS cell, round(z, 6) AS z FROM z",
    "grid_mirror": f"""WITH {V.SIGNATURES} SELECT pos, array_to_string(list_transform(range(48), lambda k: CAST(colour[(k // 12 * 4 + 3 - k // 3 % 4) * 3 + k % 3 + 1] AS INTEGER)), ',') AS colour,
        array_to_string(list_transform(range(16), lambda k: CAST(detail[k // 4 * 4 + 3 - k % 4 + 1] AS INTEGER)), ',') AS detail FROM signatures""",
    "signature_similarity": f"""WITH {_Z} SELECT x.pos, round(greatest({_raw_sim('y')}, {_raw_sim('m')}), 6) AS sim, round(100 * {_colour_sim('y')}, 6) AS colour, round(100 * {_detail_sim('y')}, 6) AS detail
        FROM full_sig x JOIN full_sig y ON y.pos = x.pos + 1 JOIN flipped m ON m.pos = x.pos + 1""",
    "temporal_similarity": f"WITH {_DELTA} SELECT x.pos, round(x.mag, 6) AS mag, round({_TEMPORAL}, 6) AS temporal FROM mags x JOIN mags y ON y.pos = x.pos + 1",
    "integrity_score": f"""WITH {V.SEGMENTS} SELECT seg_id, round(0.84 * conf + 0.053 * frames * 3 + 0.053 * frames * 2 + 0.054 * conf / 2, 6) AS integrity,
        CASE WHEN conf >= 75 THEN 'good' WHEN conf >= 50 THEN 'fair' ELSE 'poor' END AS class FROM segments""",
}
ORACLES["frame_similarity"] = f"""WITH pairs AS ({ORACLES['pair_similarity']}), sigs AS ({ORACLES['signature_similarity']}), temps AS ({ORACLES['temporal_similarity']})
    SELECT p.pos, round(CASE WHEN p.pos % 7 = 0 THEN p.sim WHEN p.pos % 3 = 0 OR t.temporal < 0 THEN 0.84 * p.sim + 0.16 * s.sim ELSE 0.70 * p.sim + 0.14 * s.sim + 0.16 * t.temporal END, 5) AS frame_sim
    FROM pairs p JOIN sigs s USING (pos) JOIN temps t USING (pos)"""
ORACLES["pixel_crops"] = ORACLES["crop_rects"]
