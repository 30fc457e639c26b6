"""Perceptual hashes of gray grids held as arrays, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row: a lambda evaluates what it captures for every element, unless that is another lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("double"), lambda s, x: s + x)


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def _bits(tests: Column) -> Column:
    return F.array_join(F.transform(tests, lambda t: F.when(t, F.lit("1")).otherwise(F.lit("0"))), "")


def average_hash(grid: Column, size: int, reference: Column | None = None) -> Column:
    """A bit for each cell: at least the mean of `reference` (the grid itself if none)."""

    def bits(g: Column) -> Column:
        return let(total(g if reference is None else reference), lambda mean_of: _bits(F.transform(g, lambda x: x * size >= mean_of)))

    return let(grid, bits)


def difference_hash(grid: Column, width: int, height: int) -> Column:
    """Bits for right > left, row by row, then for below > above."""
    places = [(y * width + x, y * width + x + 1) for y in range(height) for x in range(width - 1)]
    places += [(k, k + width) for k in range(width * (height - 1))]
    at = F.expr("array(" + ", ".join(f"named_struct('a', {a}, 'b', {b})" for a, b in places) + ")")
    return let(grid, lambda g: _bits(F.transform(at, lambda p: F.get(g, p["b"]) > F.get(g, p["a"]))))


def mirror(grid: Column, width: int, height: int, values: int = 1) -> Column:
    """Columns in opposite order; each cell holds `values` numbers."""
    source = [(row * width + width - 1 - col) * values + part for row in range(height) for col in range(width) for part in range(values)]
    return let(grid, lambda g: F.transform(F.expr(f"array({', '.join(map(str, source))})"), lambda k: F.get(g, k)))


def box_blur(grid: Column, width: int, height: int) -> Column:
    """Mean of the 3 x 3 neighbourhood, cut at the edges."""

    def mean(g: Column, k: Column) -> Column:
        row, col = F.floor(k / width).cast("int"), (k % width).cast("int")
        sum_, n = F.lit(0.0), F.lit(0)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                inside = (row + dy).between(0, height - 1) & (col + dx).between(0, width - 1)
                sum_ = sum_ + F.when(inside, F.get(g, (row + dy) * width + col + dx)).otherwise(0.0)
                n = n + inside.cast("int")
        return sum_ / n

    return let(grid, lambda g: F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: mean(g, k)))


def is_flat(grid: Column, size: int) -> Column:
    """Population variance below 1: such a frame's hashes are all zeros."""
    of = lambda g: let(total(g) / size, lambda mean: total(F.transform(g, lambda x: (x - mean) * (x - mean))) / size < 1)
    return let(grid, of)


def guarded(grid: Column, size: int, bits: Column, n_bits: int) -> Column:
    return F.when(is_flat(grid, size), F.lit("0" * n_bits)).otherwise(bits)
