"""Cohorts, sample splits and role synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeline.operators import splits
from probeline.plans.fixtures import event_records
from probeline.plans.registry import cte, query, table, with_ctes

SEED = 42
TEST, VAL = 0.2, 0.1


def cohorts_in_sql(subjects: str, seeds: str) -> str:
    return (
        "SELECT seed, subject, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + ceil(0.1::DOUBLE * (n - t)) THEN 'val' ELSE 'train' END "
        "AS role FROM (SELECT *, ceil(0.2::DOUBLE * n) AS t FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY "
        f"md5(seed || '|' || subject), subject) AS rn, count(*) OVER (PARTITION BY seed) AS n FROM {subjects} CROSS JOIN "
        f"(SELECT unnest({seeds}) AS seed)))"
    )


cte("us", "SELECT DISTINCT user_id AS subject FROM events")
cte("co", cohorts_in_sql("us", "[42]"), ("us",))


def _cohorts(spark, sf_dir):
    users = event_records(spark, sf_dir).select("subject")
    return splits.subject_cohorts(users, "subject", TEST, VAL, SEED).drop("seed")


@query(
    "k01_subject_cohorts",
    "WITH us AS (SELECT DISTINCT o_custkey AS subject FROM orders) SELECT seed::INT AS seed, subject, role FROM ("
    + cohorts_in_sql("us", "[1, 2, 3]")
    + ")",
)
def subject_cohorts(spark, sf_dir):
    """Three seeds in one job."""
    seeds = F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)]))
    subjects = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject")).distinct()
    subjects = subjects.withColumn("s", seeds)
    return splits.subject_cohorts(subjects, "subject", TEST, VAL, F.col("s"))


@query(
    "k02_stratified_split",
    "SELECT vec_id, label, CASE WHEN rn <= least(greatest(floor(share)::BIGINT + CASE WHEN ex <= wanted - taken THEN 1 ELSE 0 END, 1), n - 1) "
    "THEN 'holdout' ELSE 'train' END AS role FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY "
    "md5('42|' || vec_id), vec_id) AS rn FROM embeddings) JOIN (SELECT *, row_number() OVER (ORDER BY share - floor(share) DESC, "
    "label) AS ex, sum(floor(share)) OVER () AS taken FROM (SELECT label, n, wanted, n * wanted / total AS share FROM (SELECT label, "
    "count(*) AS n, sum(count(*)) OVER () AS total, ceil(0.3::DOUBLE * sum(count(*)) OVER ()) AS wanted FROM embeddings "
    "GROUP BY label))) USING (label)",
)
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return splits.stratified_split(rows, "label", "vec_id", 0.3, SEED)


_ROLE = "CASE session WHEN 'click' THEN 'train' WHEN 'view' THEN 'enroll' WHEN 'purchase' THEN 'probe' END"
cte("k3", f"SELECT * FROM (SELECT *, {_ROLE} AS role FROM ev) WHERE role IS NOT NULL", ("ev",))


def role_rows(spark, sf_dir):
    """Sessions as roles."""
    ev = event_records(spark, sf_dir)
    role = (
        F.when(F.col("session") == "click", "train")
        .when(F.col("session") == "view", "enroll")
        .when(F.col("session") == "purchase", "probe")
    )
    return ev.withColumn("role", role).where(F.col("role").isNotNull()).select("subject", "record", "role")


MINIMUM = {"train": 10, "enroll": 10, "probe": 10}
cte(
    "k3c",
    "SELECT subject, count_if(role = 'train')::BIGINT AS n_train, count_if(role = 'enroll')::BIGINT AS n_enroll, "
    "count_if(role = 'probe')::BIGINT AS n_probe FROM k3 GROUP BY subject",
    ("k3",),
)


@query(
    "k03_synchronised_roles",
    with_ctes(
        "k3 k3c",
        "SELECT subject, record, role FROM k3 WHERE subject IN (SELECT subject FROM k3c WHERE least(n_train, n_enroll, n_probe) >= 10)",
    ),
)
def synchronised_roles(spark, sf_dir):
    return splits.synchronise_roles(role_rows(spark, sf_dir), "subject", "role", MINIMUM)[0]


@query(
    "k03_drop_report",
    with_ctes(
        "k3c",
        "SELECT *, concat_ws(',', CASE WHEN n_train < 10 THEN 'train' END, CASE WHEN n_enroll < 10 THEN 'enroll' END, CASE WHEN "
        "n_probe < 10 THEN 'probe' END) AS reason FROM k3c",
    ),
)
def drop_report(spark, sf_dir):
    return splits.synchronise_roles(role_rows(spark, sf_dir), "subject", "role", MINIMUM)[1]


@query(
    "k04_assigned_cohorts",
    with_ctes("ev co", "SELECT ev.subject, ev.record, co.role FROM ev JOIN co USING (subject)"),
)
def assigned_cohorts(spark, sf_dir):
    rows = event_records(spark, sf_dir).select("subject", "record")
    return splits.assign_cohorts(rows, _cohorts(spark, sf_dir), "subject")


@query(
    "k04_cohort_mismatches",
    with_ctes(
        "ev co",
        "SELECT subject, a.x AS in_samples, b.x AS in_cohorts FROM (SELECT DISTINCT subject, true AS x FROM ev WHERE "
        "session = 'click' AND value >= 150) a FULL JOIN (SELECT subject, true AS x FROM co) b USING (subject) WHERE a.x IS NULL OR b.x IS NULL",
    ),
)
def cohort_mismatches(spark, sf_dir):
    """Cohorts of all users against users with a click of high value; every event is read."""
    clicks = event_records(spark, sf_dir).where((F.col("session") == "click") & (F.col("value") >= 150))
    return splits.cohort_mismatches(clicks, _cohorts(spark, sf_dir), "subject")


@query(
    "k05_disjoint_cross_session",
    with_ctes(
        "k3 co",
        "SELECT subject, record, k3.role, CASE WHEN k3.role = 'train' THEN co.role ELSE k3.role END AS part FROM k3 JOIN co "
        "USING (subject) WHERE (k3.role = 'train' AND co.role <> 'test') OR (k3.role <> 'train' AND co.role = 'test')",
    ),
)
def disjoint_cross_session(spark, sf_dir):
    return splits.disjoint_cross_session(role_rows(spark, sf_dir), _cohorts(spark, sf_dir), "subject", "role")


@query(
    "k07_enrollment_from_training",
    with_ctes(
        "k3",
        "SELECT subject, record, role FROM k3 WHERE role <> 'enroll' UNION ALL SELECT subject, record, 'enroll' FROM k3 WHERE role = 'train'",
    ),
)
def enrollment_from_training(spark, sf_dir):
    return splits.with_enrollment_role(role_rows(spark, sf_dir), "role", True)
