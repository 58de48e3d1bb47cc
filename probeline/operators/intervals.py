"""Half-open minute ranges: validation, coverage, intersection and distance.

Ranges are rows ``(keys…, start_min, end_min)``. Sorting is cut into time buckets and joins into time
bins, so a recording with most of the ranges is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from probeline.functions.ordering import prior_max, running_sum
from probeline.session import cut_lineage

BIN_MINUTES = 1440.0


def _bin(minute: Column) -> Column:
    return F.floor(minute / BIN_MINUTES)


def invalid_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges that are not finite, start before zero or do not end after their start."""
    start, end = F.col("start_min"), F.col("end_min")
    wild = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    reason = (
        F.when(wild(start) | wild(end), "not finite").when(start < 0, "negative start").when(start >= end, "empty")
    )
    return ranges.withColumn("reason", reason).where(F.col("reason").isNotNull())


def overlapping_ranges(ranges: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """Ranges that begin before an earlier range of the same key has ended."""
    seen = prior_max(ranges, keys, ["start_min", "end_min", tie], _bin(F.col("start_min")), {"__end": "end_min"})
    return seen.where(F.col("start_min") < F.col("__end")).drop("__end")


def coalesce_ranges(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge touching and overlapping ranges per key (gaps and islands)."""
    keys = list(keys)
    order = ["start_min", "end_min"]
    # a kept column, so the second step finds the rows already placed by key and day
    distinct = ranges.select(*keys, *order).distinct().withColumn("__day", _bin(F.col("start_min")))
    seen = prior_max(distinct, keys, order, "__day", {"__end": "end_min"})
    flagged = seen.withColumn(
        "__new", F.when(F.col("start_min") > F.coalesce("__end", F.lit(float("-inf"))), 1).otherwise(0)
    )
    islands = running_sum(flagged, keys, order, "__day", "__new", "__island")
    return islands.groupBy(*keys, "__island").agg(
        F.min("start_min").alias("start_min"), F.max("end_min").alias("end_min")
    ).drop("__island")


def _binned(ranges: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    last = F.ceil(F.col("end_min") / BIN_MINUTES) - 1
    return ranges.select(
        *keys,
        F.col("start_min").alias(f"{prefix}_start"),
        F.col("end_min").alias(f"{prefix}_end"),
        F.explode(F.sequence(_bin(F.col("start_min")), F.greatest(last, _bin(F.col("start_min"))))).alias("__bin"),
    )


def intersect_ranges(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Minutes covered by both: an interval join inside time bins, then coalesced.

    A pair that shares several bins is reported only in the bin where its overlap begins.
    """
    keys = list(keys)
    joined = _binned(first, keys, "a").join(_binned(second, keys, "b"), [*keys, "__bin"])
    begin, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    hits = joined.where((begin < end) & (_bin(begin) == F.col("__bin")))
    return coalesce_ranges(hits.select(*keys, begin.alias("start_min"), end.alias("end_min")), keys)


def range_separation(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest gap between two coverages per key: 0 if they touch, NULL if one is empty.

    Walking both sets by start, the nearest earlier range of the other set is the one that ended last.
    """
    keys = list(keys)
    side = lambda df, a, b: df.select(
        *keys, "start_min", "end_min", F.lit(a).alias("__a"), F.when(F.lit(a), F.col("end_min")).alias("__ea"),
        F.when(F.lit(b), F.col("end_min")).alias("__eb"),
    )
    both = side(first, True, False).unionByName(side(second, False, True))
    seen = prior_max(
        both, keys, ["start_min", "end_min", "__a"], _bin(F.col("start_min")), {"__pa": "__ea", "__pb": "__eb"}
    )
    other = F.when(F.col("__a"), F.col("__pb")).otherwise(F.col("__pa"))
    gap = F.when(other.isNotNull(), F.greatest(F.col("start_min") - other, F.lit(0.0)))
    return seen.groupBy(*keys).agg(F.min(gap).alias("gap_min"))


def covered_minutes(coalesced: DataFrame, keys: Sequence[str]) -> DataFrame:
    return coalesced.groupBy(*keys).agg(F.sum(F.col("end_min") - F.col("start_min")).alias("covered_min"))


def audit_ranges(ranges: DataFrame, keys: Sequence[str], role: str, guard_min: float) -> DataFrame:
    """One row per key: coverage per role, leakage between sources and probe, and the guard band."""
    keys = list(keys)
    merged = cut_lineage(coalesce_ranges(ranges, [*keys, role]))  # read seven times below
    part = lambda name: merged.where(F.col(role) == name).select(*keys, "start_min", "end_min")
    train, enroll, probe = part("train"), part("enroll"), part("probe")
    source = cut_lineage(coalesce_ranges(train.unionByName(enroll), keys))
    covered = merged.groupBy(*keys).agg(
        *[
            F.coalesce(
                F.sum(F.when(F.col(role) == name, F.col("end_min") - F.col("start_min"))), F.lit(0.0)
            ).alias(f"{name}_min")
            for name in ("train", "enroll", "probe")
        ],
        F.max(F.when(F.col(role) != "probe", F.col("end_min"))).alias("last_source"),
        F.min(F.when(F.col(role) == "probe", F.col("start_min"))).alias("first_probe"),
    )
    shared = covered_minutes(intersect_ranges(train, enroll, keys), keys).withColumnRenamed("covered_min", "shared_min")
    leaked = covered_minutes(intersect_ranges(source, probe, keys), keys).withColumnRenamed("covered_min", "leaked_min")
    gaps = range_separation(source, probe, keys)
    report = covered.join(shared, keys, "left").join(leaked, keys, "left").join(gaps, keys, "left")
    return report.select(
        *keys,
        "train_min",
        "enroll_min",
        "probe_min",
        F.coalesce("shared_min", F.lit(0.0)).alias("shared_min"),
        F.coalesce("leaked_min", F.lit(0.0)).alias("leaked_min"),
        "gap_min",
        F.coalesce(F.col("gap_min") < guard_min, F.lit(False)).alias("guard_broken"),
        F.coalesce(F.col("first_probe") < F.col("last_source"), F.lit(False)).alias("order_broken"),
    )
