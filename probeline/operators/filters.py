"""Projections, filters and checks on recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from probeline.functions.ordering import running_totals


def select_leads(samples: DataFrame, lead: str, wanted: str) -> DataFrame:
    """Rows of the wanted lead by normalised name: exact match, else the first lead containing it.

    ``'all'`` keeps everything. The match is decided on the distinct lead names.
    """
    if wanted.strip().lower() == "all":
        return samples
    target = wanted.strip().lower()
    names = samples.select(lead).distinct().withColumn("__name", F.lower(F.trim(F.col(lead))))
    grade = F.when(F.col("__name") == target, 0).when(F.col("__name").contains(target), 1)
    graded = names.withColumn("__grade", grade).where(F.col("__grade").isNotNull())
    best = graded.agg(F.min_by(lead, F.struct("__grade", "__name")).alias(lead))
    return samples.join(F.broadcast(best), lead, "left_semi")  # one row


def healthy_subjects(records: DataFrame, subject: str, order: list[str], code: str, healthy: str) -> DataFrame:
    """Records of subjects whose first record carries the healthy code."""
    first = records.groupBy(subject).agg(F.min(F.struct(*order, code)).alias("f"))
    kept = first.where(F.col(f"f.{code}").contains(healthy)).select(subject)
    return records.join(kept, subject, "left_semi")


def normalised_session(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_ ]", "")


def rate_mismatches(records: DataFrame, declared: str, measured: str) -> DataFrame:
    """Records whose declared and measured rates differ as whole numbers; unknown rates are skipped."""
    return records.where(F.col(declared).cast("int") != F.col(measured).cast("int"))


#: Role spellings that are accepted, by canonical role.
ROLE_ALIASES = {
    "train": ("train", "training", "true"),
    "enroll": ("enroll", "enrol", "enrollment", "enrolment"),
    "probe": ("probe", "test", "false"),
}


def canonical_role(role: Column) -> Column:
    """Canonical role name; an unknown spelling is an error."""
    text = F.lower(F.trim(role.cast("string")))
    out = None
    for name, spellings in ROLE_ALIASES.items():
        out = F.when(text.isin(*spellings), name) if out is None else out.when(text.isin(*spellings), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(text, F.lit("NULL")))))


def by_unit(records: DataFrame, unit: str, wanted: str, subject: str, excluded: DataFrame) -> DataFrame:
    """Records of one acquiring unit (or ``both``), without the excluded subjects."""
    kept = records if wanted == "both" else records.where(F.col(unit) == wanted)
    return kept.join(excluded.select(subject), subject, "left_anti")


def usable_records(samples: DataFrame, record: list[str], value: str, rate: float, smallest_std: float = 1e-5) -> DataFrame:
    """Record keys with no missing value, at least one second of samples and some variation."""
    v = F.col(value)
    facts = samples.groupBy(*record).agg(
        F.bool_or(v.isNull() | F.isnan(v)).alias("__bad"),
        F.count(F.lit(1)).alias("n_samples"),
        F.stddev_pop(value).alias("__std"),
    )
    good = ~F.col("__bad") & (F.col("n_samples") >= rate) & (F.col("__std") >= smallest_std)
    return facts.where(good).select(*record, "n_samples")


def encode_labels(df: DataFrame, label: str, name: str = "code") -> DataFrame:
    """Dense codes 0..N-1 in sorted label order, one row per distinct label.

    Only distinct labels are ordered; they are range-partitioned, so no task sees all of them.
    """
    distinct = df.select(label).distinct().withColumn("__one", F.lit(1).cast("bigint"))
    placed = running_totals(distinct, F.col(label), {"__one": "__rank"})
    return placed.select(label, (F.col("__rank") - 1).alias(name))


def first_visit_content(records: DataFrame, subject: str, visit: str, content: Column) -> DataFrame:
    """Drop a subject's copies of content already seen in an earlier visit; same-visit copies stay."""
    keyed = records.withColumn("__hash", F.sha2(content.cast("binary"), 256))
    first = keyed.groupBy(subject, "__hash").agg(F.min(visit).alias("__first"))
    joined = keyed.join(first, [subject, "__hash"])
    return joined.where(F.col(visit) == F.col("__first")).drop("__hash", "__first")


def dated(records: DataFrame, date: str) -> DataFrame:
    return records.where(F.col(date).isNotNull())


def zero_mean(samples: DataFrame, record: list[str], value: str) -> DataFrame:
    """Subtract each record's mean. The mean is aggregated map-side and joined back, so a record
    that holds most samples is never gathered in one task."""
    means = samples.groupBy(*record).agg(F.avg(value).alias("__mean"))
    return samples.join(means, record).withColumn(value, F.col(value) - F.col("__mean")).drop("__mean")
