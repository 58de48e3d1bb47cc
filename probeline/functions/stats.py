"""Distribution functions as column expressions, so p-values are computed in the plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from probeline.functions.columns import let

_STEPS = 2000


def _simpson(density, low: Column, high: Column) -> Column:
    """Integral of ``density`` from ``low`` to ``high`` with a fixed number of intervals."""
    steps = F.sequence(F.lit(0), F.lit(_STEPS))

    def term(acc, k):
        weight = F.when(k.isin(0, _STEPS), 1).when(k % 2 == 1, 4).otherwise(2)
        return acc + weight * density(low + (high - low) * k / _STEPS)

    return F.aggregate(steps, F.lit(0.0), term) * (high - low) / (3 * _STEPS)


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail probability of a standard normal statistic.

    The tail itself is integrated, from the statistic outwards and relative to the density there, so small
    probabilities keep their digits.
    """
    size = F.abs(z)
    tail = _simpson(lambda y: F.exp(-size * y - y * y / 2), F.lit(0.0), 12 / (1 + size / 3))
    return F.least(F.exp(-size * size / 2) * tail * (2 / math.sqrt(2 * math.pi)), F.lit(1.0))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic, for any degrees of freedom from 1.

    With t = sqrt(df) / tan(a) the density is a power of sin(a), and the p-value is the integral up to the
    statistic's angle over that up to a right angle. Both are taken over the stretch below their end in which the
    integrand, relative to its value there, is above exp(-40).
    """
    size, power = F.abs(t), df - 1
    angle = F.atan2(F.sqrt(df), size)
    steep = 80 / F.greatest(power, F.lit(1e-9))

    def stretch(end: Column, slope: Column) -> Column:
        width = steep / (slope + F.sqrt(slope * slope + steep))
        return let(
            F.struct(F.greatest(end - width, F.lit(0.0)).alias("low"), end.alias("high"), F.sin(end).alias("top")),
            lambda at: _simpson(
                lambda x: F.exp(power * F.ln(F.greatest(F.sin(x), F.lit(1e-300)) / at["top"])), at["low"], at["high"]
            ),
        )

    inside = stretch(angle, size / F.sqrt(df)) * F.exp(-power / 2 * F.log1p(size * size / df))
    return F.least(inside / stretch(F.lit(math.pi / 2), F.lit(0.0)), F.lit(1.0))


def _t_inner(t: float, df: int) -> float:
    angle = math.atan(t / math.sqrt(df))
    cos2 = math.cos(angle) ** 2
    term = total = 1.0
    if df % 2:
        if df == 1:
            return 2 * angle / math.pi
        for k in range(1, (df - 3) // 2 + 1):
            term *= 2 * k / (2 * k + 1) * cos2
            total += term
        return 2 / math.pi * (angle + math.sin(angle) * math.cos(angle) * total)
    for k in range(1, (df - 2) // 2 + 1):
        term *= (2 * k - 1) / (2 * k) * cos2
        total += term
    return math.sin(angle) * total


def t_quantile(level: float, df: int) -> float:
    """Two-sided critical value: |T| stays below it with probability ``level``."""
    low, high = 0.0, 1.0
    while _t_inner(high, df) < level:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _t_inner(middle, df) < level else (low, middle)
    return (low + high) / 2
