"""Row numbers, prefix sums and exact percentiles that never put one key into one task.

A plain ``row_number().over(partitionBy(key))`` sorts a whole key in a single task, and without a key
it sorts the whole table there. Here the ordering is cut into buckets that are monotone in the sort
order; small per-bucket counts give each bucket its offset, and only buckets are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from probeline.session import cut_lineage, parallelism


def _offsets(counts: DataFrame, keys: Sequence[str], bucket: str, weight: str) -> DataFrame:
    """Exclusive running total of ``weight`` over buckets. Buckets per key are few by construction."""
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__offset", F.coalesce(F.sum(weight).over(before), F.lit(0)))


def _bucketed(df: DataFrame, bucket: Column | str) -> tuple[DataFrame, str, list[str]]:
    """The bucket as a column. A named one is kept, so a later step on the same bucket finds the rows
    already placed and sorted by it."""
    if isinstance(bucket, str):
        return df, bucket, []
    return df.withColumn("__bucket", bucket), "__bucket", ["__bucket"]


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    bucket: Column | str,
    name: str = "row_no",
    total: str | None = None,
) -> DataFrame:
    """``row_number`` (from 1) in each key, equal to the window function's result.

    ``bucket`` must be non-decreasing in ``order`` and not null, as an expression or as the name of a column.
    ``total`` also adds the key's size.
    """
    keys = list(keys)
    cut, place, extra = _bucketed(df, bucket)
    counts = cut.groupBy(*keys, place).agg(F.count(F.lit(1)).alias("__rows"))
    offsets = _offsets(counts, keys, place, "__rows")
    if total:
        offsets = offsets.withColumn(total, F.sum("__rows").over(Window.partitionBy(*keys)))
    local = Window.partitionBy(*keys, place).orderBy(*order)
    return (
        cut.join(offsets.drop("__rows"), [*keys, place])
        .withColumn(name, (F.row_number().over(local) + F.col("__offset")).cast("bigint"))
        .drop("__offset", *extra)
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column | str, value: str, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` in each key, cut into buckets like ``numbered``."""
    keys = list(keys)
    cut, place, extra = _bucketed(df, bucket)
    sums = cut.groupBy(*keys, place).agg(F.sum(value).alias("__n"))
    offsets = _offsets(sums, keys, place, "__n")
    local = Window.partitionBy(*keys, place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(offsets.drop("__n"), [*keys, place])
        .withColumn(name, F.sum(value).over(local) + F.col("__offset"))
        .drop("__offset", *extra)
    )


def prior_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column | str, values: dict[str, str]
) -> DataFrame:
    """Per entry of ``values``, the largest value among the rows before this one in its key (else NULL)."""
    keys = list(keys)
    cut, place, extra = _bucketed(df, bucket)
    tops = cut.groupBy(*keys, place).agg(*[F.max(v).alias(f"__m_{n}") for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, place, *[F.max(f"__m_{n}").over(before).alias(f"__b_{n}") for n in values])
    local = Window.partitionBy(*keys, place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(tops, [*keys, place])
    for name, value in values.items():
        # greatest skips NULLs
        out = out.withColumn(name, F.greatest(F.max(value).over(local), F.col(f"__b_{name}")))
    return out.drop(*[f"__b_{n}" for n in values], *extra)


def digest_bucket(hexes: Column, digits: int = 3) -> Column:
    """Leading hex digits: a monotone, evenly filled bucket for rows ordered by a digest."""
    return F.substring(hexes, 1, digits)


def with_value_bucket(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 1024) -> DataFrame:
    """Add ``__vb``, an equal-width bucket of ``value`` between the key's smallest and largest value."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = df.join(span, keys) if keys else df.crossJoin(F.broadcast(span))  # one row without keys
    width = F.col("__hi") - F.col("__lo")
    position = F.floor((F.col(value) - F.col("__lo")) / width * buckets)
    return joined.withColumn("__vb", F.when(width > 0, position).otherwise(0).cast("bigint")).drop("__lo", "__hi")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], buckets: int = 1024
) -> DataFrame:
    """Linear-interpolation percentiles per key, one column per entry of ``wanted``.

    Equal values are counted first; then only the buckets that hold a wanted rank are sorted.
    NULL values are ignored.
    """
    keys = list(keys)
    weights = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__w"))
    cut = with_value_bucket(weights, keys, value, buckets)
    per_bucket = cut.groupBy(*keys, "__vb").agg(F.sum("__w").alias("__n"))
    offsets = _offsets(per_bucket, keys, "__vb", "__n").withColumn(
        "__total", F.sum("__n").over(Window.partitionBy(*keys))
    )
    ranks = [
        F.struct(
            F.lit(name).alias("name"),
            F.floor(F.lit(q) * (F.col("__total") - 1)).alias("low"),
            F.ceil(F.lit(q) * (F.col("__total") - 1)).alias("high"),
            (F.lit(q) * (F.col("__total") - 1)).alias("at"),
        )
        for name, q in wanted.items()
    ]
    first, last = F.col("__offset"), F.col("__offset") + F.col("__n") - 1
    targets = offsets.withColumn(
        "__targets",
        F.filter(F.array(*ranks), lambda t: (t["low"] <= last) & (t["high"] >= first)),
    ).where(F.size("__targets") > 0)
    running = Window.partitionBy(*keys, "__vb").orderBy(value)
    hits = (
        cut.join(targets.drop("__n", "__total"), [*keys, "__vb"])
        .withColumn("__end", F.sum("__w").over(running) + F.col("__offset"))
        .withColumn("__begin", F.col("__end") - F.col("__w"))
        .withColumn("__t", F.explode("__targets"))
    )
    covers = lambda rank: (F.col("__begin") <= rank) & (rank < F.col("__end"))
    picked = hits.where(covers(F.col("__t.low")) | covers(F.col("__t.high")))
    aggregates = []
    for name in wanted:
        own = F.col("__t.name") == name
        low = F.max(F.when(own & covers(F.col("__t.low")), F.col(value)))
        high = F.max(F.when(own & covers(F.col("__t.high")), F.col(value)))
        share = F.max(F.when(own, F.col("__t.at") - F.col("__t.low")))
        aggregates.append((low + (high - low) * share).alias(name))
    return picked.groupBy(*keys).agg(*aggregates)


def running_totals(
    df: DataFrame, order: Column, sums: dict[str, str], descending: bool = False
) -> DataFrame:
    """Inclusive running sums over the whole table in ``order`` (which must be unique per row).

    The table is range-partitioned and stored once, so partition ids stay fixed; one row per partition
    then carries the offsets.
    """
    spark = df.sparkSession
    sort = order.desc() if descending else order.asc()
    ranged = df.repartitionByRange(parallelism(spark), sort).withColumn("__part", F.spark_partition_id())
    stored = cut_lineage(ranged)
    before = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    totals = totals.select(
        "__part", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in sums]
    )
    local = Window.partitionBy("__part").orderBy(sort).rowsBetween(Window.unboundedPreceding, 0)
    out = stored.join(F.broadcast(totals), "__part")  # one row per partition
    for column, name in sums.items():
        out = out.withColumn(name, F.sum(column).over(local) + F.col(f"__o_{column}"))
    return out.drop("__part", *[f"__o_{c}" for c in sums])


def interval_lookup(points: DataFrame, point: str, intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Give each point the disjoint interval ``[start, end)`` that holds it.

    Points and interval starts are merged in one range-partitioned order: a point belongs to the last start at or before
    it. The interval open at a partition's border is carried on from one row per partition. Neither many intervals
    in a narrow range nor many equal points meet in one task, as equal points are told apart by a hash.
    """
    spark = points.sparkSession
    own, span = F.struct(*points.columns).alias("__p"), F.struct(*intervals.columns).alias("__iv")
    salt = F.xxhash64(F.monotonically_increasing_id()).alias("__salt")
    dots = points.select(own, F.col(point).cast("bigint").alias("__at"), F.lit(1).alias("__kind"), salt)
    spans = intervals.where(F.col(end) > F.col(start)).select(
        span, F.col(start).cast("bigint").alias("__at"), F.lit(0).alias("__kind"), F.lit(0).cast("bigint").alias("__salt")
    )
    order = ["__at", "__kind", "__salt"]
    ranged = dots.unionByName(spans, allowMissingColumns=True).repartitionByRange(parallelism(spark), *order)
    merged = cut_lineage(ranged.withColumn("__part", F.spark_partition_id()))
    tails = merged.groupBy("__part").agg(F.max_by("__iv", F.when(F.col("__iv").isNotNull(), F.col("__at"))).alias("__tail"))
    before = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("__part", F.last("__tail", ignorenulls=True).over(before).alias("__open"))
    local = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = merged.join(F.broadcast(carried), "__part").withColumn(  # one row per partition
        "__iv", F.coalesce(F.last("__iv", ignorenulls=True).over(local), "__open")
    )
    found = held.where((F.col("__kind") == 1) & (F.col("__at") < F.col("__iv")[end]))
    return found.select("__p.*", *[F.col("__iv")[c].alias(c) for c in intervals.columns])
