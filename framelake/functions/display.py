"""Text and classes for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int) -> Column:
    """x to so many digits by its product with a power of ten, halves away from 0: what SQL engines and C do to doubles. Spark's round goes by the shortest decimal text, so
    it takes 65.6390625 up, though the double is less than half."""
    x, power = F.col(x) if isinstance(x, str) else x, 10.0**digits
    up = F.floor(F.abs(x) * power + 0.5) / power
    return F.when(F.abs(x) < 1e9, F.when(x < 0, -up).otherwise(up)).otherwise(F.round(x, digits))


def two_decimals(x: Column) -> Column:
    """As C's %.2f writes it, by the exact value of the double and halves to the even digit. Java's goes by the shortest decimal text: 2.01 for 2.005, which is less."""
    size = F.abs(x)
    high = size.cast("float").cast("double")  # both parts times 200 are exact
    k = F.floor(size * 100)
    over = (high * 200 - (2 * k + 1)) + (size - high) * 200
    n = k + F.when((over > 0) | ((over == 0) & (k % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def clock(seconds: Column) -> Column:
    """m:ss.ss"""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad(two_decimals(seconds - 60 * F.floor(seconds / 60)), 5, "0"))


def confidence_class(confidence: Column, approximate: Column) -> Column:
    return F.when(approximate, "approx").when(confidence >= 80, "high").when(confidence >= 60, "medium").otherwise("low")


def timeline_class(confidence: Column) -> Column:
    return F.when(confidence >= 80, "strong").when(confidence >= 60, "fair").otherwise("weak")


def speed_label(ratio: Column) -> Column:
    return (
        F.when(F.abs(ratio - 1) <= 0.08, F.lit(""))
        .when(ratio < 1, F.concat(F.lit("slowed "), two_decimals(1 / ratio), F.lit("×")))
        .otherwise(F.concat(F.lit("sped up "), two_decimals(ratio), F.lit("×")))
    )


def observed_ratio(movie_seconds: Column, clip_seconds: Column) -> Column:
    return movie_seconds / F.greatest(F.lit(0.001), clip_seconds)


def integrity(structure: Column, colour: Column, skin: Column, detail: Column) -> Column:
    return 0.84 * structure + 0.053 * colour + 0.053 * skin + 0.054 * detail


def checklist_class(value: Column) -> Column:
    v = F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))
    return F.when(v >= 75, "good").when(v >= 50, "fair").otherwise("poor")


def crop_label(name: Column) -> Column:
    """A crop's name for people: 9:16 crops by number, zooms by factor and place."""
    part = lambda k: F.regexp_extract(name, r"^zoom_(\d)_(\d+)_(center|left|right)$", k)
    return (
        F.when(name == "full", "Full Frame")
        .when(name.startswith("crop_9_16_"), F.concat(F.lit("9:16 Crop "), (F.substring(name, 11, 1).cast("int") + 1).cast("string")))
        .when(F.length(part(0)) > 0, F.concat(F.lit("Zoom "), part(1), F.lit("."), part(2), F.lit("x "), F.initcap(part(3))))
        .otherwise(name)
    )


def match_parameters(min_similarity: float | None, min_frames: int | None, drift: float | None) -> tuple[float, int, int]:
    """Values outside their ranges give way to the defaults 82, 9 and 3."""
    ok = lambda x, a, b: isinstance(x, (int, float)) and a <= x <= b
    return (
        min_similarity if ok(min_similarity, 20, 99) else 82,
        int(min_frames) if ok(min_frames, 3, 200) else 9,
        int(drift + 0.5) if ok(drift, 0, 15) else 3,
    )


def frames_of_seconds(seconds: float) -> int:
    return max(5, int(seconds * 25 + 0.5))


def hash_grid(bits: Column, side: int = 16) -> Column:
    """The first side x side bits as rows of a square; null if there are fewer."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda k: F.substr(bits, k * side + 1, F.lit(side)))
    return F.when(F.length(bits) >= side * side, rows)


def hash_prefix(bits: Column) -> Column:
    return F.when(F.coalesce(F.length(bits), F.lit(0)) == 0, "—").otherwise(F.concat(F.substring(bits, 1, 48), F.lit("…")))


def sequence_average(sequence: Column) -> Column:
    """Mean similarity of a segment's matched frames; null without any."""
    return F.when(F.size(sequence) > 0, F.aggregate(sequence, F.lit(0.0), lambda s, x: s + x["similarity"]) / F.size(sequence))


def packed_bytes(frames: Column, variants: Column, a_words: Column, d_words: Column) -> Column:
    """Estimated memory of a packed video: hashes and mirrored hashes in words of 4 bytes, 48 changes of colour and their length, and 1,400 bytes a frame."""
    return frames * variants * (a_words + d_words) * 8 + frames * (48 * 4 + 4 + 1400)
