"""Bit vectors as strings of 0 and 1, and packed as longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(bits: Column, size: int) -> list[Column]:
    """A bit string as ceil(size / 64) long columns: scalar columns keep Hamming distances inside generated code."""
    return [F.conv(F.rpad(F.substring(bits, 1 + 64 * k, 64), 64, "0"), 2, -10).cast("bigint") for k in range(-(-size // 64))]


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits of two packed vectors."""
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def similarity_percentage(a: list[Column], b: list[Column], size: int) -> Column:
    return (1 - hamming(a, b) / size) * 100


def char_hamming(a: Column, b: Column) -> Column:
    """Characters of a that b does not have at their place; where b is shorter, all beyond it."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))
    return F.when(F.length(a) == 0, 0).otherwise(F.length(a) - F.aggregate(same, F.lit(0), lambda s, x: s + x))


def char_compare(a: Column, b: Column) -> Column:
    """Share of equal characters in percent; 0 for empty strings or different lengths."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.length(a) == 0) | (F.length(a) != F.length(b)), 0.0).otherwise(same / F.length(a) * 100)


def pair_similarity(a: Column, d: Column | None, flip_a: Column | None = None, flip_d: Column | None = None) -> Column:
    """Percent, from shares of equal bits: a alone, or 0.55 a + 0.45 d; the better of normal and mirrored."""
    normal = a if d is None else 0.55 * a + 0.45 * d
    if flip_a is None:
        return normal * 100
    return F.greatest(normal, flip_a if flip_d is None else 0.55 * flip_a + 0.45 * flip_d) * 100


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)
