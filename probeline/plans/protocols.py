"""The eight study protocols on ``embeddings``: closed set, subject disjoint, cross session and both,
each as identification and as verification; five seeds in one job.

Even ids are the first session (training, also enrollment), odd ids the second (probe).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from probeline.functions.columns import rounded
from probeline.operators import inference, splits, studies
from probeline.plans import matching
from probeline.plans.registry import cte, query, r, with_ctes

SEEDS = (42, 43, 44, 45, 46)
HOLDOUT, TEST, VAL, ENROLL = 0.3, 0.4, 0.1, 10


def closed_set(spark, sf_dir) -> DataFrame:
    """Every identity on both sides: training rows enroll, held-out rows probe."""
    rows = matching.vectors(spark, sf_dir)
    parts = [splits.stratified_split(rows, "label", "id", HOLDOUT, seed).withColumn("seed", F.lit(seed)) for seed in SEEDS]
    role = F.when(F.col("role") == "train", "enroll").otherwise("probe")
    return reduce(DataFrame.unionByName, parts).withColumn("role", role)


def _cohorts(rows: DataFrame) -> DataFrame:
    seeded = rows.select("label").distinct().withColumn("s", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    return splits.subject_cohorts(seeded, "label", TEST, VAL, F.col("s"))


def subject_disjoint(spark, sf_dir) -> DataFrame:
    """Only test identities; their first rows enroll, the rest probe."""
    rows = matching.vectors(spark, sf_dir)
    test = _cohorts(rows).where(F.col("role") == "test").select("seed", "label")
    return splits.enroll_probe_split(rows.join(test, "label"), ["seed", "label"], ["id"], ENROLL)


def _sessions(spark, sf_dir) -> DataFrame:
    rows = matching.vectors(spark, sf_dir)
    return rows.withColumn("role", F.when(F.col("id") % 2 == 0, "enroll").otherwise("probe"))


def cross_session(spark, sf_dir) -> DataFrame:
    """Identities with at least five rows in both sessions; one run."""
    kept, _ = splits.synchronise_roles(_sessions(spark, sf_dir), "label", "role", {"enroll": 5, "probe": 5})
    return kept.withColumn("seed", F.lit(SEEDS[0]))


def disjoint_cross_session(spark, sf_dir) -> DataFrame:
    """Both sessions, test identities only."""
    rows = _sessions(spark, sf_dir)
    test = _cohorts(rows).where(F.col("role") == "test").select("seed", "label")
    return rows.join(test, "label")


cte(
    "zq",
    "SELECT seed, vec_id, label, CASE WHEN rn <= least(greatest(floor(share)::BIGINT + CASE WHEN ex <= wanted - taken THEN 1 ELSE 0 END, 1), n - 1) "
    "THEN 'probe' ELSE 'enroll' END AS role FROM (SELECT seed, vec_id, label, row_number() OVER (PARTITION BY seed, label ORDER BY "
    "md5(seed || '|' || vec_id), vec_id) AS rn FROM embeddings CROSS JOIN (SELECT unnest([42, 43, 44, 45, 46]) AS seed)) JOIN (SELECT *, "
    "row_number() OVER (ORDER BY share - floor(share) DESC, label) AS ex, sum(floor(share)) OVER () AS taken FROM (SELECT label, n, wanted, "
    "n * wanted / total AS share FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total, ceil(0.3::DOUBLE * sum(count(*)) OVER ()) "
    "AS wanted FROM embeddings GROUP BY label))) USING (label)",
)
cte(
    "zc",
    "SELECT seed, label, CASE WHEN rn <= ceil(0.4::DOUBLE * n) THEN 'test' ELSE 'other' END AS cohort FROM (SELECT *, row_number() OVER "
    "(PARTITION BY seed ORDER BY md5(seed || '|' || label), label) AS rn, count(*) OVER (PARTITION BY seed) AS n FROM (SELECT DISTINCT label "
    "FROM embeddings) CROSS JOIN (SELECT unnest([42, 43, 44, 45, 46]) AS seed))",
)
cte(
    "zd",
    "SELECT zc.seed, s.vec_id, s.label, s.role FROM s JOIN zc ON s.label = zc.label AND zc.cohort = 'test'",
    ("s", "zc"),
)
cte("zs", "SELECT 42 AS seed, vec_id, label, CASE WHEN vec_id % 2 = 0 THEN 'enroll' ELSE 'probe' END AS role FROM embeddings")
cte(
    "zx",
    "SELECT zc.seed, zs.vec_id, zs.label, zs.role FROM zs JOIN zc ON zs.label = zc.label AND zc.cohort = 'test'",
    ("zs", "zc"),
)


def study_ctes(name: str, source: str) -> None:
    """Templates and scores of one role table, and its error curve."""
    cte(
        f"{name}_t",
        f"SELECT seed, identity, list_transform(t, lambda x: x / (sqrt(list_dot_product(t, t)) + 1e-10)) AS t FROM (SELECT seed, label AS "
        f"identity, list(m ORDER BY pos) AS t FROM (SELECT seed, label, pos, avg(x) AS m FROM (SELECT z.seed, z.label, unnest(u.e) AS x, "
        f"generate_subscripts(u.e, 1) AS pos FROM {source} z JOIN u USING (vec_id) WHERE z.role = 'enroll') GROUP BY seed, label, pos) "
        "GROUP BY seed, label)",
        (source, "u"),
    )
    cte(
        f"{name}_s",
        f"SELECT z.seed, z.vec_id, z.label, t.identity, list_dot_product(u.n, t.t) AS score FROM {source} z JOIN u USING (vec_id) JOIN "
        f"{name}_t t ON t.seed = z.seed WHERE z.role = 'probe'",
        (source, "u", f"{name}_t"),
    )
    cte(
        f"{name}_c",
        "SELECT *, (sum(g) OVER w / sum(g) OVER a)::DOUBLE AS tar, (sum(i) OVER w / sum(i) OVER a)::DOUBLE AS far, ((sum(g) OVER w - g) / sum(g) "
        "OVER a)::DOUBLE AS tar0, ((sum(i) OVER w - i) / sum(i) OVER a)::DOUBLE AS far0 FROM (SELECT seed, score, count_if(label = identity) AS g, "
        f"count_if(label <> identity) AS i FROM {name}_s GROUP BY seed, score) WINDOW w AS (PARTITION BY seed ORDER BY score DESC), a AS "
        "(PARTITION BY seed)",
        (f"{name}_s",),
    )


def identification_sql(name: str) -> str:
    return with_ctes(
        f"{name}_s {name}_t",
        f"SELECT seed, count(*) AS n_probes, gs.n AS n_identities, {r('avg((rk <= 1)::INT)')} AS rank_1, CASE WHEN gs.n > 5 THEN "
        f"{r('avg((rk <= 5)::INT)')} END AS rank_5 FROM (SELECT seed, vec_id, count_if(score >= own) AS rk FROM (SELECT *, max(CASE WHEN label = "
        f"identity THEN score END) OVER (PARTITION BY seed, vec_id) AS own FROM {name}_s) GROUP BY seed, vec_id) JOIN (SELECT seed, count(*) AS n "
        f"FROM {name}_t GROUP BY seed) gs USING (seed) GROUP BY seed, gs.n",
    )


def verification_sql(name: str) -> str:
    return with_ctes(
        f"{name}_s {name}_c",
        f"SELECT e.seed, d.g AS n_genuine, d.i AS n_impostor, {r('e.eer')} AS eer, {r('e.auc')} AS auc, "
        f"{r('abs(d.mg - d.mi) / sqrt(0.5 * (d.vg + d.vi) + 1e-10)')} AS d_prime, CASE WHEN 1 / d.i <= 0.001 THEN {r('e.tf')} END AS tar_at_far FROM "
        "(SELECT seed, coalesce(min_by(far, -score) FILTER (far - (1 - tar) = 0), min_by(0.5 * (far0 + f * (far - far0) + (1 - tar0) + f * "
        "((1 - tar) - (1 - tar0))), -score) FILTER ((far - (1 - tar)) * (far0 - (1 - tar0)) < 0)) AS eer, sum((far - far0) * (tar + tar0) / 2) AS "
        "auc, coalesce(max(tar) FILTER (far <= 0.001 + 32 * 2.220446049250313e-16), 0) AS tf FROM (SELECT *, -(far0 - (1 - tar0)) / ((far - "
        f"(1 - tar)) - (far0 - (1 - tar0))) AS f FROM {name}_c) GROUP BY seed) e JOIN (SELECT seed, count_if(label = identity)::BIGINT AS g, "
        "count_if(label <> identity)::BIGINT AS i, avg(score) FILTER (label = identity) AS mg, avg(score) FILTER (label <> identity) AS mi, "
        f"var_pop(score) FILTER (label = identity) AS vg, var_pop(score) FILTER (label <> identity) AS vi FROM {name}_s GROUP BY seed) d "
        "USING (seed)",
    )


PROTOCOLS = {
    "q1_closed_set_identification": ("w1", "zq", closed_set, True),
    "q2_closed_set_verification": ("w1", "zq", closed_set, False),
    "q3_subject_disjoint_identification": ("w3", "zd", subject_disjoint, True),
    "q4_subject_disjoint_verification": ("w3", "zd", subject_disjoint, False),
    "q5_cross_session_identification": ("w5", "zs", cross_session, True),
    "q6_cross_session_verification": ("w5", "zs", cross_session, False),
    "q7_disjoint_cross_session_identification": ("w7", "zx", disjoint_cross_session, True),
    "q8_disjoint_cross_session_verification": ("w7", "zx", disjoint_cross_session, False),
}


def _register(name: str, prefix: str, rows, identify: bool) -> None:
    study = studies.identification_study if identify else studies.verification_study
    rates = ("rank_1", "rank_5") if identify else ("eer", "auc", "d_prime", "tar_at_far")

    @query(name, identification_sql(prefix) if identify else verification_sql(prefix))
    def run(spark, sf_dir):
        out = study(rows(spark, sf_dir))
        for rate in rates:
            out = out.withColumn(rate, rounded(rate))
        return out


for _prefix, _source in dict((p, z) for p, z, _, _ in PROTOCOLS.values()).items():
    study_ctes(_prefix, _source)
for _name, (_prefix, _, _rows, _identify) in PROTOCOLS.items():
    _register(_name, _prefix, _rows, _identify)


@query(
    "q3_over_seeds",
    "WITH q AS (" + identification_sql("w3") + f") SELECT 'rank_1' AS metric, count(*) AS n_runs, {r('avg(rank_1)', 5)} AS mean, "
    f"{r('stddev_samp(rank_1)', 5)} AS sample_std, {r('avg(rank_1) - 2.7764451051977934 * stddev_samp(rank_1) / sqrt(count(*))', 5)} AS lower, "
    f"{r('avg(rank_1) + 2.7764451051977934 * stddev_samp(rank_1) / sqrt(count(*))', 5)} AS upper FROM q",
)
def over_seeds(spark, sf_dir):
    """Rank-1 over the seeds with its t interval."""
    study = studies.identification_study(subject_disjoint(spark, sf_dir))
    runs = study.select("seed", F.lit("rank_1").alias("metric"), F.col("rank_1").alias("value"))
    out = inference.uncertainty(runs, ["metric"]).select("metric", "n_runs", "mean", "sample_std", "lower", "upper")
    for column in ("mean", "sample_std", "lower", "upper"):
        out = out.withColumn(column, rounded(column, 5))
    return out
