"""Training-only augmentation of vectors.

Random numbers come from a digest of seed, row id and position, not from a generator bound to a task,
so a recomputed partition gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from probeline.functions.columns import array_sum, digest, digest_int, digest_uniform, let
from probeline.operators.signal import array_std


def _uniform(seed: Column | int, *keys: Column) -> Column:
    return digest_uniform(digest(seed if isinstance(seed, Column) else F.lit(seed), *keys))


def _normal(seed, row: Column, at: Column) -> Column:
    """Standard normal number by the Box-Muller transform of two digest parts."""
    def both(hexes):
        radius = F.sqrt(-2 * F.log((digest_int(hexes, 1) + 1) / 4294967296.0))
        return radius * F.cos(2 * math.pi * digest_uniform(hexes, 9))

    return let(digest(seed if isinstance(seed, Column) else F.lit(seed), row, at), both)


def gaussian(vec: Column, row: Column, seed, std: float = 0.01, relative: bool = True) -> Column:
    """Additive noise, absolute or relative to the row's standard deviation."""
    size = let(array_std(vec), lambda s: s * std) if relative else F.lit(std)
    return let(size, lambda w: F.transform(vec, lambda x, i: x + w * _normal(seed, row, i)))


def amplitude(vec: Column, row: Column, seed, low: float = 0.8, high: float = 1.2) -> Column:
    """One random factor per row."""
    return let(low + (high - low) * _uniform(seed, row), lambda f: F.transform(vec, lambda x: x * f))


def timeshift(vec: Column, row: Column, seed, most: int = 10) -> Column:
    """Circular shift by a whole number in [-most, most]."""
    drawn = digest_int(digest(seed if isinstance(seed, Column) else F.lit(seed), row)) % (2 * most + 1) - most

    def rolled(shift):
        return let(
            F.pmod(shift, F.size(vec)).cast("int"),
            lambda k: F.concat(F.slice(vec, F.size(vec) - k + 1, k), F.slice(vec, F.lit(1), F.size(vec) - k)),
        )

    return let(drawn, rolled)


def baseline_wander(vec: Column, row: Column, seed, rate: float, freq: float = 0.3, amp: float = 0.05) -> Column:
    """Slow sine with a random phase per row."""
    return let(
        2 * math.pi * _uniform(seed, row),
        lambda phase: F.transform(vec, lambda x, i: x + amp * F.sin(2 * math.pi * freq * i / rate + phase)),
    )


def _interpolated(at: Column, xs: Column, ys: Column) -> Column:
    """Linear interpolation on increasing ``xs``, constant beyond the ends."""
    # place of the last knot not after ``at``
    left = F.greatest(F.size(F.filter(xs, lambda x: x <= at)) - 1, F.lit(0))

    def between(k):
        right = F.least(k + 1, F.size(xs) - 1)
        x0, x1, y0, y1 = F.get(xs, k), F.get(xs, right), F.get(ys, k), F.get(ys, right)
        return F.when((x1 > x0) & (at > x0), y0 + (y1 - y0) * (at - x0) / (x1 - x0)).otherwise(y0)

    return let(left, between)


def time_warp(vec: Column, row: Column, seed, sigma: float = 0.2, knots: int = 4) -> Column:
    """Monotone time deformation with log-normal intervals between evenly spaced knots."""
    count = knots + 1
    last = (F.size(vec) - 1).cast("double")
    places = F.sequence(F.lit(0), F.lit(count))
    steps = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.exp(sigma * _normal(seed, row, k)))

    def warped(intervals):
        reach = F.transform(places, lambda k: array_sum(F.slice(intervals, F.lit(1), k)))
        scaled = let(reach, lambda r: F.transform(r, lambda x: x * last / F.get(r, F.lit(count))))
        control = F.transform(places, lambda k: k * last / count)
        return let(F.struct(control.alias("c"), scaled.alias("w")), times)

    def times(knot):
        index = F.sequence(F.lit(0), F.size(vec) - 1)
        moved = F.transform(index, lambda i: _interpolated(i.cast("double"), knot["c"], knot["w"]))
        return let(moved, lambda m: F.transform(index, lambda i: _interpolated(i.cast("double"), m, vec)))

    return F.when(F.size(vec) < 2, vec).otherwise(let(steps, warped))


def cutout(vec: Column, row: Column, seed, holes: int = 1, length: int = 20) -> Column:
    """Zero ``holes`` runs of ``length`` samples."""
    base = seed if isinstance(seed, Column) else F.lit(seed)
    starts = F.array(
        *[digest_int(digest(base, row, F.lit(h))) % (F.size(vec) - length + 1) for h in range(holes)]
    )
    return let(
        starts,
        lambda begin: F.transform(
            vec, lambda x, i: F.when(F.exists(begin, lambda b: (i >= b) & (i < b + length)), 0.0).otherwise(x)
        ),
    )


def emg_noise(vec: Column, row: Column, seed, std: float = 0.05) -> Column:
    """High-frequency noise: differences of white noise, scaled to the row's standard deviation."""
    white = F.transform(vec, lambda x, i: _normal(seed, row, i))
    steep = let(white, lambda n: F.transform(n, lambda x, i: x - F.when(i > 0, F.get(n, i - 1)).otherwise(0.0)))

    def mixed(noise):
        return let(
            std * (array_std(vec) + 1e-8) / (array_std(noise) + 1e-8),
            lambda f: F.zip_with(vec, noise, lambda x, n: x + f * n),
        )

    return let(steep, mixed)


METHODS = {
    "gaussian": gaussian,
    "amplitude": amplitude,
    "timeshift": timeshift,
    "baseline_wander": baseline_wander,
    "time_warp": time_warp,
    "cutout": cutout,
    "emg_noise": emg_noise,
}


def augment(df: DataFrame, steps: dict[str, dict], copies: int, seed: int, row: str = "id", vec: str = "vec") -> DataFrame:
    """Original rows (``copy`` 0) and ``copies`` changed versions, each with its own seed.

    Leads of one beat that share ``row`` share the random choice. No shuffle: copies are exploded in place.
    """
    changed = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    base = F.lit(seed) + F.col("copy")
    out = F.col(vec)
    for name, options in steps.items():
        out = METHODS[name](out, F.col(row), base, **options)
        changed = changed.withColumn(vec, out)
        out = F.col(vec)
    return df.withColumn("copy", F.lit(0)).unionByName(changed)
