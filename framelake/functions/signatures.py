"""Colour, skin and detail signatures of a frame's 4 x 4 cells, and the similarities built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.hashing import let, mirror, total


def is_skin(r: Column, g: Column, b: Column) -> Column:
    return (r > 80) & (g > 40) & (b > 20) & (r > g) & (r > b) & (r - b > 20)


def normalised_colours(grid: Column) -> Column:
    """Each RGB channel's z-scores over the 16 cells; a population deviation under 8 counts as 8."""

    def statistics(g: Column, c: int) -> Column:
        own = F.filter(g, lambda _, i: i % 3 == c)
        deviation = lambda mean: F.greatest(F.sqrt(total(F.transform(own, lambda x: (x - mean) * (x - mean))) / 16), F.lit(8.0))
        return let(total(own) / 16, lambda mean: F.struct(mean.alias("mean"), deviation(mean).alias("deviation")))

    def scores(g: Column) -> Column:
        channels = F.array(*[statistics(g, c) for c in range(3)])
        return let(channels, lambda s: F.transform(g, lambda x, i: (x - F.get(s, i % 3)["mean"]) / F.get(s, i % 3)["deviation"]))

    return let(grid, scores)


def mean_difference(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def colour_similarity(a: Column, b: Column) -> Column:
    """From normalised colours, 0 to 1."""
    return F.greatest(F.lit(0.0), 1 - mean_difference(a, b) / 2)


def skin_similarity(a: Column, b: Column) -> Column:
    return 1 - mean_difference(a, b)


def detail_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.lit(1.0), F.array_max(a).cast("double"), F.array_max(b).cast("double"))
    return 1 - mean_difference(a, b) / most


def signature_similarity(colour_a: Column, skin_a: Column, detail_a: Column, colour_b: Column, skin_b: Column, detail_b: Column, mirrored: bool = True) -> Column:
    """Percent: the mean of the channels, the better of b and b mirrored; colours normalised."""

    def raw(c: Column, s: Column, d: Column) -> Column:
        return (colour_similarity(colour_a, c) + skin_similarity(skin_a, s) + detail_similarity(detail_a, d)) / 3 * 100

    if not mirrored:
        return raw(colour_b, skin_b, detail_b)
    return F.greatest(raw(colour_b, skin_b, detail_b), raw(mirror(colour_b, 4, 4, 3), mirror(skin_b, 4, 4), mirror(detail_b, 4, 4)))


def raw_signature_similarity(colour_a: Column, skin_a: Column, detail_a: Column, colour_b: Column, skin_b: Column, detail_b: Column) -> Column:
    """Percent: the mean of the channels that both frames have in one size, 50 without any. Colours of 48 numbers are normalised, others
    are taken as they are."""
    both = lambda a, b: (F.size(a) > 0) & (F.size(a) == F.size(b))
    z = colour_similarity(normalised_colours(colour_a), normalised_colours(colour_b))
    colour = F.when((F.size(colour_a) == 48) & (F.size(colour_b) == 48), z).when(both(colour_a, colour_b), 1 - mean_difference(colour_a, colour_b) / 255)
    skin = F.when(both(skin_a, skin_b), skin_similarity(skin_a, skin_b))
    detail = F.when(both(detail_a, detail_b), detail_similarity(detail_a, detail_b))
    present = F.filter(F.array(colour, skin, detail), lambda x: x.isNotNull())
    return let(present, lambda c: F.when(F.size(c) == 0, 50.0).otherwise(total(c) / F.size(c) * 100))


def temporal_similarity(delta_a: Column, mag_a: Column, delta_b: Column, mag_b: Column, pos_a: Column | None = None, pos_b: Column | None = None) -> Column:
    """Percent, of two frames' changes of colour: 78 if both hardly change, 38 if one does, else from their cosine. -1, for
    saying nothing, where either frame is a video's first (position 0)."""
    dot = total(F.zip_with(delta_a, delta_b, lambda x, y: x * y))
    first = F.lit(False)
    for pos in (pos_a, pos_b):
        first = first if pos is None else first | (pos == 0)
    return F.when(first, -1.0).when((mag_a < 6) & (mag_b < 6), 78.0).when((mag_a < 6) | (mag_b < 6), 38.0).otherwise((dot / (mag_a * mag_b) + 1) / 2 * 100)


def frame_similarity(structure: Column, signature: Column, temporal: Column) -> Column:
    """Percent; signature null where a frame has none, temporal null or below 0 where it says nothing."""
    return (
        F.when(signature.isNull(), structure)
        .when(temporal.isNull() | (temporal < 0), 0.84 * structure + 0.16 * signature)
        .otherwise(0.70 * structure + 0.14 * signature + 0.16 * temporal)
    )
