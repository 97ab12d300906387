"""Three-vector algebra and input estimates as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cross(a: Column, b: Column) -> Column:
    term = lambda i, j: F.get(a, i) * F.get(b, j) - F.get(a, j) * F.get(b, i)
    return F.array(term(1, 2), term(2, 0), term(0, 1))


def kpoint_grid(first: Column, second: Column, third: Column, density: float, minimum: int = 3, bump: int = 0, equal: bool = False) -> Column:
    """Per direction max(minimum, ceil(density * reciprocal length + 0.5) + bump); null if singular."""
    determinant = dot(first, cross(second, third))
    sides = F.array(cross(second, third), cross(third, first), cross(first, second))
    lengths = F.transform(sides, lambda v: F.sqrt(dot(v, v)) / F.abs(determinant))
    grid = F.transform(lengths, lambda x: F.greatest(F.lit(minimum), (F.ceil(x * density + 0.5) + bump).cast("int")))
    if equal:
        grid = F.transform(grid, lambda _: F.array_max(grid))
    return F.when(F.abs(determinant) >= 1e-12, grid)


def band_count(electrons: Column, atoms: Column, spin: Column, moment: Column, divisor: int | None = None) -> Column:
    """The largest estimate for the spin setting, made even and a multiple of ``divisor``."""
    half = F.ceil(F.greatest(F.lit(6), atoms) / 2)
    most_filled = F.floor(electrons * 0.6 + 1)
    polarised = F.greatest(most_filled + half, most_filled + F.ceil(F.abs(moment) / 2), most_filled + 20)
    plain = F.greatest(F.floor(electrons / 2 + 2) + half, F.ceil(electrons / 2) + 20)
    bands = F.when(spin == 2, polarised).otherwise(plain).cast("long")
    even = bands + bands % 2
    return even + F.pmod(-even, F.lit(divisor)) if divisor else even
