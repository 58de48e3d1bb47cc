"""Relation of per-subject drift covariates to an outcome score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from probeline.functions.ordering import running_totals
from probeline.functions.stats import t_two_sided


def _correlation(a: str, b: str) -> Column:
    """Pearson correlation of complete pairs; NULL instead of an error where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def template_correlation(templates: DataFrame, subject: str) -> DataFrame:
    """Pearson correlation of a subject's enrollment and probe template and the drift ``1 - r``.

    ``templates(subject, role, pos, value)``. NULL where a template is constant or lengths differ.
    """
    sides = templates.groupBy(subject, "pos").agg(
        F.max(F.when(F.col("role") == "enroll", F.col("value"))).alias("x"),
        F.max(F.when(F.col("role") == "probe", F.col("value"))).alias("y"),
    )
    facts = sides.groupBy(subject).agg(
        _correlation("x", "y").alias("r"),
        F.stddev_pop("x").alias("sx"),
        F.stddev_pop("y").alias("sy"),
        F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("same_shape"),
    )
    usable = F.col("same_shape") & (F.col("sx") > 0) & (F.col("sy") > 0)
    r = F.when(usable, F.col("r"))
    return facts.select(subject, r.alias("correlation"), (1 - r).alias("drift"))


def subject_covariates(statistics: DataFrame, bounds: DataFrame, subject: str) -> DataFrame:
    """Changes between a subject's enrollment and probe side.

    ``statistics(subject, role, heart_rate, amplitude, n_records)``; ``bounds(subject, elapsed_days)``.
    """
    def side(name: str, column: str) -> Column:
        return F.max(F.when(F.col("role") == name, F.col(column)))

    wide = statistics.groupBy(subject).agg(
        side("enroll", "heart_rate").alias("he"),
        side("probe", "heart_rate").alias("hp"),
        side("enroll", "amplitude").alias("ae"),
        side("probe", "amplitude").alias("ap"),
        side("enroll", "n_records").alias("ne"),
        side("probe", "n_records").alias("np"),
    ).where(F.col("ne").isNotNull() & F.col("np").isNotNull())
    positive = (F.col("ae") > 0) & (F.col("ap") > 0)
    return wide.join(bounds, subject, "left").select(
        subject,
        "elapsed_days",
        F.abs(F.col("hp") - F.col("he")).alias("heart_rate_change"),
        F.when(positive, F.log(F.try_divide(F.col("ap"), F.col("ae")))).alias("amplitude_log_ratio"),
        F.log(F.greatest("np", F.lit(1)) / F.greatest("ne", F.lit(1))).alias("record_count_log_ratio"),
    )


def complete_cases(covariates: DataFrame, scores: DataFrame, subject: str, names: Sequence[str]) -> DataFrame:
    """Subjects with an outcome and every covariate: ``subject, outcome, names…``."""
    joined = covariates.join(scores, subject)
    for name in [*names, "outcome"]:
        value = F.col(name).cast("double")
        joined = joined.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    return joined.select(subject, F.col("outcome").cast("double").alias("outcome"), *[F.col(n).cast("double").alias(n) for n in names])


def average_ranks(cases: DataFrame, name: str, rank: str) -> DataFrame:
    """Add the average rank of ``name``. Equal values are counted first, then summed in order."""
    counts = cases.groupBy(name).agg(F.count(F.lit(1)).alias("__c"))
    placed = running_totals(counts, F.col(name), {"__c": "__upto"})
    ranks = placed.select(name, (F.col("__upto") - (F.col("__c") - 1) / 2).alias(rank))
    return cases.join(ranks, name)


def univariate(cases: DataFrame, names: Sequence[str], fewest: int = 4) -> DataFrame:
    """Spearman and Pearson with the outcome per covariate; constant covariates are flagged, and below
    ``fewest`` subjects nothing is estimated."""
    ranked = average_ranks(cases, "outcome", "__ro")
    for name in names:
        ranked = average_ranks(ranked, name, f"__r_{name}")
    facts = []
    for name in names:
        facts += [
            _correlation(f"__r_{name}", "__ro").alias(f"rho_{name}"),
            _correlation(name, "outcome").alias(f"r_{name}"),
            (F.max(name) - F.min(name)).alias(f"w_{name}"),
            F.max(F.abs(name)).alias(f"m_{name}"),
        ]
    one = ranked.agg(F.count(F.lit(1)).alias("n"), *facts)
    rows = one.select("n", F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("covariate"),
            (F.col(f"w_{name}") <= 1e-8 + 1e-5 * F.col(f"m_{name}")).alias("constant"),
            F.col(f"rho_{name}").alias("rho"),
            F.col(f"r_{name}").alias("r"),
        )
        for name in names
    ])).alias("c")).select("n", "c.*")
    usable = ~F.col("constant") & (F.col("n") >= fewest)
    freedom = F.col("n") - 2

    def p(value: Column) -> Column:
        t = value * F.sqrt(F.try_divide(freedom, F.greatest(1 - value * value, F.lit(1e-300))))
        return t_two_sided(t, F.greatest(freedom, F.lit(1)))

    return rows.select(
        "covariate", "n", "constant",
        F.when(usable, F.col("rho")).alias("spearman"), F.when(usable, p(F.col("rho"))).alias("spearman_p"),
        F.when(usable, F.col("r")).alias("pearson"), F.when(usable, p(F.col("r"))).alias("pearson_p"),
    )


def _moments(cases: DataFrame, names: Sequence[str]):
    """Count, means and centred cross products in two passes; (p + 1)^2 numbers reach the driver."""
    import numpy as np

    columns = [*names, "outcome"]
    first = cases.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns]).first()
    centred = [F.col(c) - F.lit(first[c]) for c in columns]
    sums = cases.agg(
        *[F.sum(a * b).alias(f"s{i}_{j}") for i, a in enumerate(centred) for j, b in enumerate(centred) if i <= j]
    ).first()
    size = len(columns)
    cross = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
    return first["n"], first["outcome"], cross


def joint_model(cases: DataFrame, names: Sequence[str]) -> DataFrame:
    """Least squares on standardised covariates: coefficient and variance inflation per covariate, and
    R² of the whole model. Constant covariates are left out; NULL without enough subjects.

    One distributed pass sums the cross products; only their small matrix is solved on the driver.
    """
    import numpy as np

    spark = cases.sparkSession
    n, mean, cross = _moments(cases, names)
    scale = np.sqrt(np.diag(cross)[:-1] / n)
    used = [i for i in range(len(names)) if scale[i] > 1e-8]
    schema = (
        "covariate string, coefficient double, vif double, intercept double, r_squared double, "
        "adjusted_r_squared double, n bigint"
    )
    if not used or n <= len(used) + 1:
        return spark.createDataFrame([], schema)
    r = cross[np.ix_(used, used)] / n / np.outer(scale[used], scale[used])
    target = cross[used, -1] / n / scale[used]
    beta, *_ = np.linalg.lstsq(r, target, rcond=None)
    total = cross[-1, -1]
    r2 = float(n * target @ beta / total) if total > 0 else None
    freedom = n - len(used) - 1
    adjusted = 1 - (1 - r2) * (n - 1) / freedom if r2 is not None and freedom > 0 else None
    singular = np.linalg.matrix_rank(r) < len(used)
    vif = np.full(len(used), np.inf) if singular else np.diag(np.linalg.inv(r))
    rows = [
        (names[i], float(b), float(v), float(mean), r2, adjusted, int(n)) for i, b, v in zip(used, beta, vif)
    ]
    return spark.createDataFrame(rows, schema)
