"""The thirteen crops of a frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.bits import js_round


def even(x: Column) -> Column:
    return (F.floor(x / 2) * 2).cast("int")


def crop_rects(w: Column, h: Column) -> Column:
    """Array of (name, sx, sy, sw, sh): the whole frame, five 9:16 crops, zooms of 1.25 and 1.5 at three places, of 2 in the centre."""

    def rect(name: str, sx: Column, sy: Column, sw: Column, sh: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), sx.cast("int").alias("sx"), sy.cast("int").alias("sy"), sw.cast("int").alias("sw"), sh.cast("int").alias("sh"))

    zero = F.lit(0)
    tall = even(js_round(h * 9 / 16))
    out = [rect("full", zero, zero, w, h)]
    for i in range(5):
        fits = tall <= w
        sx = even(js_round(i * (w - tall) / 4))
        out.append(rect(f"crop_9_16_{i}", F.when(fits, sx).otherwise(0), zero, F.when(fits, tall).otherwise(w), h))
    for zoom, name, places in ((1.25, "zoom_1_25", "clr"), (1.5, "zoom_1_5", "clr"), (2.0, "zoom_2_0", "c")):
        zw, zh = (even(F.least(x, F.greatest(F.lit(1), js_round(x / zoom)))) for x in (w, h))
        sy = even(js_round((h - zh) / 2))
        for place in places:
            label, sx = {"c": ("center", js_round((w - zw) / 2)), "l": ("left", zero), "r": ("right", w - zw)}[place]
            out.append(rect(f"{name}_{label}", even(sx), sy, zw, zh))
    return F.array(*out)
