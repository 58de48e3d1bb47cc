"""Column builders shared by the operators. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(seed: int | str | Column, *keys: Column | str) -> Column:
    """md5 of ``seed|key|…``: the deterministic shuffle key, independent of partitioning."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", first.cast("string"), *[p.cast("string") for p in parts]).cast("binary"))


def digest_int(hexes: Column, start: int = 1, length: int = 8) -> Column:
    """An unsigned integer from ``length`` hex digits of a digest."""
    return F.conv(F.substring(hexes, start, length), 16, 10).cast("bigint")


def digest_uniform(hexes: Column, start: int = 1) -> Column:
    """A uniform number in [0, 1) from eight hex digits."""
    return digest_int(hexes, start) / F.lit(4294967296.0)


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded output. A tiny shift first moves exact ties off the boundary, where the last bit of a
    sum (which depends on task order) would decide the digit."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column + F.lit(10.0 ** -(digits + 3)), digits)


def rounded_many(value: Column | str, digits: int = 6) -> Column:
    """``rounded`` for columns of very many rows: decimal arithmetic only near a tie and for large numbers."""
    column = F.col(value) if isinstance(value, str) else value
    scaled_up = (column + F.lit(10.0 ** -(digits + 3))) * F.lit(10.0**digits)
    lower = F.floor(scaled_up)
    clear = (F.abs(scaled_up) < 1e9) & (F.abs(scaled_up - lower - 0.5) > 1e-6)  # NaN is greater than any number
    return F.when(clear, F.floor(scaled_up + 0.5) / F.lit(10.0**digits)).otherwise(rounded(column, digits))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in index order, the same order the block kernel uses."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``. An outer expression used inside a lambda
    would be evaluated for every array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scaled(a: Column, divisor: Column) -> Column:
    return let(divisor, lambda d: F.transform(a, lambda x: x / d))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def as_double_array(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("array<double>")


#: Added to a vector's length before dividing by it, so that a zero vector scores 0.
LENGTH_EPSILON = 1e-10

SIMILARITIES = ("cosine", "euclidean", "manhattan", "pearson")


def prepared(vec: Column, method: str) -> Column:
    """Do the per-vector part of a similarity once per vector instead of once per pair."""
    if method == "cosine":
        return scaled(vec, norm(vec) + F.lit(LENGTH_EPSILON))
    if method == "pearson":
        centred = let(array_sum(vec) / F.size(vec), lambda m: F.transform(vec, lambda x: x - m))
        return let(centred, lambda c: scaled(c, F.when(norm(c) > 0, norm(c)).otherwise(F.lit(float("nan")))))
    if method in SIMILARITIES:
        return vec
    raise ValueError(f"unknown similarity {method!r}, expected one of {SIMILARITIES}")


def similarity(a: Column, b: Column, method: str) -> Column:
    """Score of two prepared vectors; higher means more alike."""
    if method in ("cosine", "pearson"):
        return dot(a, b)
    if method == "euclidean":
        gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
        return -F.sqrt(array_sum(gaps))
    if method == "manhattan":
        return -array_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    raise ValueError(f"unknown similarity {method!r}, expected one of {SIMILARITIES}")
