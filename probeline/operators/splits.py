"""Assignment of subjects and samples to roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from probeline.functions.columns import digest
from probeline.functions.ordering import digest_bucket, numbered
from probeline.operators.templates import first_per_key


def enroll_probe_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Add ``role``: the first ``n`` rows of a key in ``order`` enroll, the rest probe.

    Only the boundary row per key is found by ranking (a group limit below the shuffle); every row is
    then compared with it.
    """
    keys, order = list(keys), list(order)
    first = first_per_key(df, keys, order, n)
    cut = first.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__cut"))
    role = F.when(F.struct(*order) <= F.col("__cut"), "enroll").otherwise("probe")
    return df.join(cut, keys).withColumn("role", role).drop("__cut")


def keys_without_probe(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Keys whose rows are all used up by enrollment; a valid split returns none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") <= n)


def subject_cohorts(
    subjects: DataFrame, subject: str, test_share: float, val_share: float, seed: Column | int
) -> DataFrame:
    """Disjoint train, val and test cohorts over distinct subjects, test first.

    Sizes are ``ceil`` of the share: test of all subjects, val of what remains. Order is by digest.
    ``seed`` may be a column, so many seeds are drawn in one job; it is kept as ``seed``.
    """
    value = seed if isinstance(seed, Column) else F.lit(seed)
    distinct = subjects.select(subject, value.alias("seed")).distinct()
    keyed = distinct.withColumn("__d", digest(F.col("seed"), subject))
    ranked = numbered(keyed, ["seed"], ["__d", subject], digest_bucket(F.col("__d")), "__rn", total="__n")
    n_test = F.ceil(F.lit(test_share) * F.col("__n"))
    n_val = F.ceil(F.lit(val_share) * (F.col("__n") - n_test))
    role = (
        F.when(F.col("__rn") <= n_test, "test")
        .when(F.col("__rn") <= n_test + n_val, "val")
        .otherwise("train")
    )
    return ranked.select("seed", subject, role.alias("role"))


def stratified_split(df: DataFrame, label: str, key: str, holdout: float, seed: Column | int) -> DataFrame:
    """Add ``role`` train/holdout with every label on both sides.

    The held-out total is ``ceil(holdout * n)``. Each label gets the floor of its share and the largest
    remainders get one more. If that leaves a label without a row on either side, the split is refused.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    wanted = F.ceil(F.lit(holdout) * F.col("__all"))
    share = F.col("__n") * wanted / F.col("__all")
    quotas = (
        counts.crossJoin(F.broadcast(total))  # one row
        .withColumn("__floor", F.floor(share))
        .withColumn("__left", share - F.floor(share))
        .withColumn("__wanted", wanted)
    )
    floors = quotas.agg(F.sum("__floor").alias("__taken"))
    ranked = numbered(
        quotas, [], [F.desc("__left"), F.asc(label)], -F.floor(F.col("__left") * 1024), "__rn"
    ).crossJoin(F.broadcast(floors))  # one row
    extra = F.when(F.col("__rn") <= F.col("__wanted") - F.col("__taken"), 1).otherwise(0)
    quota = F.least(F.greatest(F.col("__floor") + extra, F.lit(1)), F.col("__n") - 1)
    quotas = ranked.select(label, quota.alias("__quota"), "__wanted", "__n")
    held = quotas.agg(F.sum("__quota").alias("__held"))
    refused = (F.col("__held") != F.col("__wanted")) | (F.col("__n") < 2)
    message = F.lit("no split of this size has every label on both sides")
    checked = quotas.crossJoin(F.broadcast(held)).select(  # one row
        label, F.when(refused, F.raise_error(message).cast("bigint")).otherwise(F.col("__quota")).alias("__quota")
    )
    value = seed if isinstance(seed, Column) else F.lit(seed)
    keyed = df.withColumn("__d", digest(value, key))
    order = numbered(keyed, [label], ["__d", key], digest_bucket(F.col("__d"), 2), "__rn")
    role = F.when(F.col("__rn") <= F.col("__quota"), "holdout").otherwise("train")
    return order.join(checked, label).withColumn("role", role).drop("__d", "__rn", "__quota")


def labels_too_small(df: DataFrame, label: str) -> DataFrame:
    """Labels that cannot stand on both sides of a split."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") < 2)


def synchronise_roles(
    rows: DataFrame, subject: str, role: str, minimum: dict[str, int]
) -> tuple[DataFrame, DataFrame]:
    """Rows of subjects that reach the minimum count in every role, and the drop report.

    One aggregate counts all roles, so the intersection needs no set operation per role.
    """
    counts = rows.groupBy(subject).agg(
        *[F.count_if(F.col(role) == name).alias(f"n_{name}") for name in minimum]
    )
    missing = [F.when(F.col(f"n_{name}") < least, F.lit(name)) for name, least in minimum.items()]
    judged = counts.withColumn("reason", F.concat_ws(",", *missing))
    kept = rows.join(judged.where(F.col("reason") == "").select(subject), subject, "left_semi")
    return kept, judged


def assign_cohorts(samples: DataFrame, cohorts: DataFrame, subject: str) -> DataFrame:
    """Samples with their subject's role; subjects without a cohort are an error."""
    joined = samples.join(cohorts, subject, "left")
    known = F.when(F.col("role").isNull(), F.raise_error(F.lit("subject has no cohort")).cast("string"))
    return joined.withColumn("role", known.otherwise(F.col("role")))


def cohort_mismatches(samples: DataFrame, cohorts: DataFrame, subject: str) -> DataFrame:
    """Subjects that are only in the samples or only in the cohorts."""
    have = samples.select(subject).distinct().withColumn("in_samples", F.lit(True))
    told = cohorts.select(subject).distinct().withColumn("in_cohorts", F.lit(True))
    both = have.join(told, subject, "full_outer")
    return both.where(F.col("in_samples").isNull() | F.col("in_cohorts").isNull())


def disjoint_cross_session(rows: DataFrame, cohorts: DataFrame, subject: str, role: str) -> DataFrame:
    """Training-role rows of train/val subjects; enrollment and probe rows of test subjects only."""
    joined = rows.join(cohorts.select(subject, F.col("role").alias("cohort")), subject)
    part = (
        F.when((F.col(role) == "train") & F.col("cohort").isin("train", "val"), F.col("cohort"))
        .when(F.col(role).isin("enroll", "probe") & (F.col("cohort") == "test"), F.col(role))
    )
    return joined.withColumn("part", part).where(F.col("part").isNotNull()).drop("cohort")


def with_enrollment_role(rows: DataFrame, role: str, reuse_training: bool) -> DataFrame:
    """Give the study an enrollment role: its own rows, or the training rows a second time."""
    if not reuse_training:
        return rows
    others = rows.where(F.col(role) != "enroll")
    doubled = F.when(F.col(role) == "train", F.array(F.lit("train"), F.lit("enroll"))).otherwise(
        F.array(F.col(role))
    )
    return others.withColumn(role, F.explode(doubled))
