"""Aggregation over seeds, uncertainty and paired comparison of two conditions.

Run tables are long: ``(keys…, seed, value)``. A group has one row per seed, so the arrays built below
are as long as the number of runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from probeline.functions.columns import array_sum, digest, digest_int, let
from probeline.functions.ordering import numbered, prior_max
from probeline.functions.stats import normal_two_sided, t_quantile, t_two_sided
from probeline.session import cut_lineage

RESAMPLES = 10_000
BOOTSTRAP_SEED = 12345
#: Differences closer than this many units in the last place count as equal.
TOLERANCE = 32 * 2.220446049250313e-16


def per_run_rows(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str], base_seed: int) -> DataFrame:
    """One row per run and metric from one column per metric; ``seed`` is ``base_seed + run_index``."""
    seeded = wide.withColumn("seed", F.col("run_index") + base_seed)
    return seeded.unpivot([*keys, "run_index", "seed"], list(metrics), "metric", "value")


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def aggregate_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation, NULL as soon as one run is missing or not finite."""
    facts = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.bool_and(F.coalesce(_finite(F.col("value")), F.lit(False))).alias("__whole"),
        F.avg("value").alias("__m"),
        F.stddev_pop("value").alias("__s"),
    )
    mean = F.when(F.col("__whole"), F.col("__m"))
    std = F.when(F.col("__whole"), F.col("__s"))
    return facts.select(*keys, "n_runs", mean.alias("mean"), std.alias("std"))


def run_text(mean: Column, std: Column) -> Column:
    """``mean ± std`` with four decimals; ``n/a`` where unavailable."""
    return F.when(mean.isNull(), "n/a").otherwise(F.format_string("%.4f ± %.4f", mean, std))


def parse_run_text(text: Column) -> tuple[Column, Column]:
    """Numbers back out of ``mean ± std``; anything else gives NULL."""
    pattern = r"^\s*([-+0-9.eE]+)\s*±\s*([-+0-9.eE]+)\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k).try_cast("double")
    return part(1), part(2)


def _critical_values(counts: DataFrame, level: float) -> DataFrame:
    """t quantiles for the run counts that occur, one row each."""
    spark = counts.sparkSession
    sizes = sorted(row["n_runs"] for row in counts.select("n_runs").distinct().collect() if row["n_runs"] > 1)
    rows = [(n, t_quantile(level, n - 1)) for n in sizes] or [(2, t_quantile(level, 1))]
    return spark.createDataFrame(rows, "n_runs bigint, critical double")


def uncertainty(runs: DataFrame, keys: Sequence[str], level: float = 0.95) -> DataFrame:
    """Student-t interval of the mean. One run has no interval; a missing run leaves the metric out."""
    facts = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.bool_and(F.coalesce(_finite(F.col("value")), F.lit(False))).alias("__whole"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sample_std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ).where("__whole").drop("__whole")
    error = F.col("sample_std") / F.sqrt("n_runs")
    joined = facts.join(F.broadcast(_critical_values(facts, level)), "n_runs", "left")
    return joined.withColumn("standard_error", error).select(
        *keys,
        "n_runs",
        "mean",
        "sample_std",
        "standard_error",
        "min",
        "max",
        (F.col("mean") - F.col("critical") * F.col("standard_error")).alias("lower"),
        (F.col("mean") + F.col("critical") * F.col("standard_error")).alias("upper"),
    )


def bootstrap_interval(
    runs: DataFrame, keys: Sequence[str], level: float = 0.95, resamples: int = RESAMPLES, seed: int = BOOTSTRAP_SEED
) -> DataFrame:
    """Percentile bootstrap of the mean; draws come from a digest of seed, resample and place."""
    keys = list(keys)
    rows = F.array_sort(F.collect_list(F.struct("seed", "value")))
    values = runs.groupBy(*keys).agg(F.transform(rows, lambda r: r["value"]).alias("v"))
    whole = values.where(F.forall("v", lambda x: F.coalesce(_finite(x), F.lit(False))) & (F.size("v") >= 2))
    drawn = whole.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    n = F.size("v")
    picks = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get("v", (digest_int(digest(seed, F.col("b"), i)) % n).cast("int")),
    )
    means = drawn.select(*keys, (array_sum(picks) / n).alias("m"))
    tail = (1 - level) / 2
    return means.groupBy(*keys).agg(  # exactly ``resamples`` rows per group
        F.percentile("m", tail).alias("lower"), F.percentile("m", 1 - tail).alias("upper")
    )


# --- paired comparison -----------------------------------------------------------------------------


def align_conditions(reference: DataFrame, comparison: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full join by seed: ``reference``, ``comparison`` and ``paired`` (both present)."""
    left = reference.select(*keys, "seed", F.col("value").alias("reference"), F.lit(True).alias("__l"))
    right = comparison.select(*keys, "seed", F.col("value").alias("comparison"), F.lit(True).alias("__r"))
    joined = left.join(right, [*keys, "seed"], "full_outer")
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    return joined.withColumn("paired", both).drop("__l", "__r")


def common_metrics(runs: DataFrame, keys: Sequence[str], metric: str = "metric") -> DataFrame:
    """Metrics that every seed of the group has with a value."""
    seeds = runs.groupBy(*keys).agg(F.count_distinct("seed").alias("__all"))
    present = runs.where(F.col("value").isNotNull()).groupBy(*keys, metric).agg(F.count_distinct("seed").alias("n_seeds"))
    joined = present.join(seeds, list(keys)) if keys else present.crossJoin(F.broadcast(seeds))  # one row without keys
    return joined.where(F.col("n_seeds") == F.col("__all")).drop("__all")


def difference_profile(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Differences ``comparison - reference`` per group, with constant and all-zero flags."""
    d = F.col("comparison") - F.col("reference")
    facts = paired.withColumn("d", d).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("d").alias("mean_difference"),
        F.stddev_samp("d").alias("__s"),
        F.min("d").alias("__lo"),
        F.max("d").alias("__hi"),
        F.min_by("d", "seed").alias("__first"),
    )
    largest = F.greatest(F.abs("__lo"), F.abs("__hi"))
    tolerance = F.greatest(F.lit(1.0), largest) * TOLERANCE
    spread = F.greatest(F.col("__hi") - F.col("__first"), F.col("__first") - F.col("__lo"))
    constant = spread <= tolerance
    return facts.select(
        *keys,
        "n_pairs",
        "mean_difference",
        F.when(constant | (F.col("n_pairs") < 2), 0.0).otherwise(F.col("__s")).alias("std_difference"),
        constant.alias("constant"),
        (largest <= tolerance).alias("all_zero"),
    )


def effect_size(profile: DataFrame) -> DataFrame:
    """Add ``dz``: mean over deviation of the differences; 0 without effect, infinite without spread."""
    signed = F.when(F.col("mean_difference") < 0, float("-inf")).otherwise(float("inf"))
    value = (
        F.when(F.col("all_zero"), 0.0)
        .when(F.col("std_difference") == 0, signed)
        .otherwise(F.try_divide(F.col("mean_difference"), F.col("std_difference")))
    )
    return profile.withColumn("dz", value)


def t_test(profile: DataFrame) -> DataFrame:
    """Add the paired ``t`` and its two-sided ``p``; NULL below two pairs."""
    signed = F.when(F.col("mean_difference") < 0, float("-inf")).otherwise(float("inf"))
    spread = F.try_divide(F.col("std_difference"), F.sqrt("n_pairs"))
    statistic = (
        F.when(F.col("n_pairs") < 2, None)
        .when(F.col("all_zero"), 0.0)
        .when(F.col("std_difference") == 0, signed)
        .otherwise(F.try_divide(F.col("mean_difference"), spread))
    )
    p = (
        F.when(F.col("n_pairs") < 2, None)
        .when(F.col("all_zero"), 1.0)
        .when(F.col("std_difference") == 0, 0.0)
        .otherwise(t_two_sided(F.col("t"), F.greatest(F.col("n_pairs") - 1, F.lit(1))))
    )
    return profile.withColumn("t", statistic).withColumn("p", p)


def difference_interval(profile: DataFrame, level: float = 0.95) -> DataFrame:
    """Add the t interval of the mean difference; NULL below two pairs."""
    sized = profile.withColumnRenamed("n_pairs", "n_runs")
    joined = sized.join(F.broadcast(_critical_values(sized, level)), "n_runs", "left").withColumnRenamed("n_runs", "n_pairs")
    margin = F.when(F.col("n_pairs") >= 2, F.col("critical") * F.col("std_difference") / F.sqrt("n_pairs"))
    return (
        joined.withColumn("diff_lower", F.col("mean_difference") - margin)
        .withColumn("diff_upper", F.col("mean_difference") + margin)
        .drop("critical")
    )


def _exact_signed_rank_p(n: Column, statistic: Column) -> Column:
    """Two-sided p: share of the 2^n sign choices whose rank sum is at most the statistic, doubled.

    The counts of all rank sums are built rank by rank, never by listing sign choices.
    """
    top = (n * (n + 1) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), top), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")),
        start,
        lambda acc, r: F.transform(acc, lambda v, s: v + F.when(s >= r, F.get(acc, s - r)).otherwise(0.0)),
    )
    below = array_sum(F.slice(counts, F.lit(1), F.floor(statistic).cast("int") + 1))
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))


def signed_rank_test(paired: DataFrame, keys: Sequence[str], exact_limit: int = 50) -> DataFrame:
    """Wilcoxon signed-rank test: zero differences dropped, average ranks, two-sided.

    Exact when there are no ties or zeros and at most ``exact_limit`` pairs, else the normal
    approximation with tie correction. ``w`` is the smaller rank sum.
    """
    keys = list(keys)
    profile = difference_profile(paired, keys)
    d = paired.withColumn("d", F.col("comparison") - F.col("reference")).where(F.col("d") != 0)
    sized = d.withColumn("a", F.abs("d"))
    ties = sized.groupBy(*keys, "a").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down")
    )
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("a").rowsBetween(Window.unboundedPreceding, 0))
    # average rank of a tied set: the middle of the places it takes
    ranked = ties.withColumn("rank", upto - (F.col("n") - 1) / 2)
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").alias("m"),
        F.sum(F.col("rank") * F.col("up")).alias("plus"),
        F.sum(F.col("rank") * F.col("down")).alias("minus"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"),
    )
    joined = profile.join(sums, keys, "left").withColumn("w", F.least("plus", "minus"))
    m = F.col("m")
    variance = m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48
    z = F.try_divide(F.col("w") - m * (m + 1) / 4, F.sqrt(variance))
    exact = (m <= exact_limit) & (F.col("ties") == 0) & (m == F.col("n_pairs"))
    few = F.least(F.coalesce(m, F.lit(1)), F.lit(exact_limit))  # the unused branch stays small
    p = F.when(exact, _exact_signed_rank_p(few, F.least(F.col("w"), F.lit(exact_limit * exact_limit)))).otherwise(
        normal_two_sided(z)
    )
    usable = F.col("n_pairs") >= 2
    # identical conditions: no ranks, no evidence
    same = F.col("all_zero") | m.isNull()
    return joined.select(
        *keys,
        "n_pairs",
        F.when(usable, F.when(same, 0.0).otherwise(F.col("w"))).alias("w"),
        F.when(usable, F.when(same, 1.0).otherwise(p)).alias("p"),
    )


def holm(tests: DataFrame, family: Sequence[str], p: str, row_id: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Step-down adjustment in each family; untested hypotheses (NULL) stay out of the family.

    Families may be large: places and the running maximum come from p-value buckets.
    """
    family = list(family)
    tests = cut_lineage(tests)  # read several times, and p-values are costly to make
    known = tests.where(F.col(p).isNotNull()).withColumn("__pb", F.floor(F.col(p) * 256))
    order = [p, *row_id]
    placed = numbered(known, family, order, "__pb", "__r", total="__m")
    scaled = placed.withColumn("__x", (F.col("__m") - F.col("__r") + 1) * F.col(p))
    running = prior_max(scaled, family, order, "__pb", {"__before": "__x"})
    adjusted = F.least(F.lit(1.0), F.greatest("__x", "__before"))
    done = running.withColumn("adjusted_p", adjusted).withColumn("reject", F.col("adjusted_p") < alpha)
    untested = tests.where(F.col(p).isNull()).withColumn("adjusted_p", F.lit(None).cast("double"))
    untested = untested.withColumn("reject", F.lit(None).cast("boolean"))
    return done.drop("__r", "__m", "__x", "__before", "__pb").unionByName(untested)


def significance_marker(p: Column) -> Column:
    return (
        F.when(p.isNull(), "n/a").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")
    )


def paired_report(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Everything about a paired comparison in one row per group."""
    profile = difference_interval(t_test(effect_size(difference_profile(paired, keys))))
    ranks = signed_rank_test(paired, keys).select(*keys, "w", F.col("p").alias("p_w"))
    means = paired.groupBy(*keys).agg(
        F.avg("reference").alias("reference_mean"), F.avg("comparison").alias("comparison_mean")
    )
    return profile.join(means, list(keys)).join(ranks, list(keys))
