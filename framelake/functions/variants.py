"""Comparisons of frames over all their variants: crops and zooms, each with hashes and mirrored hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.bits import pair_similarity
from framelake.functions.display import crop_label
from framelake.functions.hashing import let


def words(bits: Column) -> Column:
    """A bit string of any length as an array of longs; null if it is null or empty."""
    last = (F.floor((F.length(bits) - 1) / 64)).cast("int")
    word = lambda k: F.conv(F.rpad(F.substr(bits, k * 64 + 1, F.lit(64)), 64, "0"), 2, -10).cast("bigint")
    return F.when(F.length(bits) > 0, F.transform(F.sequence(F.lit(0), last), word))


def in_order(variants: Column) -> Column:
    """A map of variants as an array of (later, name, a, d, fa, fd), hashes packed: the one named full first, then by name.
    Variants without a hash are left out."""

    def packed(e: Column) -> Column:
        v = e["value"]
        hashes = (words(v[c]).alias(n) for c, n in (("hash", "a"), ("dhash", "d"), ("fhash", "fa"), ("fdhash", "fd")))
        return F.struct((e["key"] != "full").alias("later"), e["key"].alias("name"), *hashes)

    return F.array_sort(F.filter(F.transform(F.map_entries(variants), packed), lambda x: x["a"].isNotNull()))


def _share(a: Column, b: Column, size: int) -> Column:
    """Of equal bits; null if either is missing or they differ in length."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / size


def _pair(x: Column, y: Column, a_size: int, d_size: int) -> Column:
    """Percent, from both hashes, or from the first alone where the second is missing; the better of normal and mirrored."""
    both = pair_similarity(_share(x["a"], y["a"], a_size), _share(x["d"], y["d"], d_size), _share(x["a"], y["fa"], a_size), _share(x["d"], y["fd"], d_size))
    one = pair_similarity(_share(x["a"], y["a"], a_size), None, _share(x["a"], y["fa"], a_size))
    return F.coalesce(both, one)


def best_cross(own: Column, other: Column, a_size: int = 256, d_size: int = 480) -> Column:
    """(sim, name): percent of the best pair of variants, and the name of `other`'s variant in it, the first on ties. Null without variants."""

    def best(s: Column, o: Column) -> Column:
        row = lambda x, i: F.transform(o, lambda y, j: F.struct(_pair(x, y, a_size, d_size).alias("sim"), (-(i * F.size(o) + j)).alias("first"), y["name"].alias("name")))
        return F.array_max(F.transform(s, lambda x, i: F.array_max(row(x, i))))

    found = let(other, lambda o: let(own, lambda s: best(s, o)))
    return let(found, lambda b: F.when(b.isNotNull(), F.struct(b["sim"].alias("sim"), b["name"].alias("name"))))


def fast_cross(own: Column, other: Column, a_size: int = 256, d_size: int = 480) -> Column:
    """Percent: `own`'s variant named full (the first, without one) against all of `other`'s."""
    return let(F.get(own, F.lit(0)), lambda x: F.array_max(F.transform(other, lambda y: _pair(x, y, a_size, d_size))))


def compare_fingerprints(own: Column, other: Column, size: int = 256) -> Column:
    """Percent: the best pair of variants by the first hash alone, not mirrored; 0 without any."""
    best = lambda s, o: F.array_max(F.transform(s, lambda x: F.array_max(F.transform(o, lambda y: _share(x["a"], y["a"], size)))))
    return F.coalesce(let(other, lambda o: let(own, lambda s: best(s, o))) * 100, F.lit(0.0))


def frame_detail(own: Column, other: Column, colour: Column, skin: Column, detail: Column, a_size: int = 256, d_size: int = 480) -> Column:
    """cropRegion, structureSim and each channel's similarity in percent, of shares from 0 to 1 (not mirrored): cut to 0 to 100, and 50
    where one is null."""
    percent = lambda c: F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), c * 100)), F.lit(50.0))
    region = lambda b: F.when(b.isNull() | (b["sim"] <= 0), "Full Frame").otherwise(crop_label(b["name"]))
    return let(
        best_cross(own, other, a_size, d_size),
        lambda b: F.struct(
            region(b).alias("cropRegion"), F.coalesce(b["sim"], F.lit(0.0)).alias("structureSim"),
            percent(colour).alias("colorSim"), percent(skin).alias("skinSim"), percent(detail).alias("detailSim"),
        ),
    )
