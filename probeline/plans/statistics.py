"""Uncertainty over seeds, paired tests, drift covariates and result tables.

Runs: for every seed a digest-picked half of the events; even and odd events are two conditions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from probeline.functions.columns import digest, digest_int, rounded
from probeline.functions.stats import t_two_sided
from probeline.operators import covariates, inference, tables
from probeline.plans import signals
from probeline.plans.registry import cte, query, r, table, with_ctes
from probeline.session import cut_lineage, parallelism

RUNS = 8
BASE = 100
METRICS = ("mean_value", "spread", "click_share", "energy", "unit")
GROUP = ["condition", "metric"]

cte(
    "rw",
    "SELECT condition, run_index, avg(value) AS mean_value, stddev_pop(value) AS spread, avg((event_type = 'click')::INT) AS "
    "click_share, CASE WHEN run_index <> 3 THEN avg(value * value) END AS energy, 1.0::DOUBLE AS unit FROM (SELECT *, CASE WHEN "
    f"event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS condition FROM events CROSS JOIN (SELECT unnest(range({RUNS}))::INT AS "
    f"run_index)) WHERE ('0x' || substr(md5(({BASE} + run_index) || '|' || event_id), 1, 8))::BIGINT < 2147483648 GROUP BY "
    "condition, run_index",
)
cte(
    "ru",
    " UNION ALL ".join(
        f"SELECT condition, run_index, run_index + {BASE} AS seed, '{m}' AS metric, {m} AS value FROM rw" for m in METRICS
    ),
    ("rw",),
)
cte(
    "pa",
    "SELECT metric, a.seed, a.value AS reference, b.value AS comparison, b.value - a.value AS d FROM (SELECT * FROM ru WHERE "
    "condition = 'even') a JOIN (SELECT * FROM ru WHERE condition = 'odd') b USING (metric, seed) WHERE a.value IS NOT NULL AND "
    "b.value IS NOT NULL",
    ("ru",),
)


def wide_runs(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn(
        "run_index", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1)))
    )
    picked = events.where(digest_int(digest(F.col("run_index") + BASE, "event_id")) < 2147483648)
    even = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    return picked.groupBy(even.alias("condition"), "run_index").agg(
        F.avg("value").alias("mean_value"),
        F.stddev_pop("value").alias("spread"),
        F.avg((F.col("event_type") == "click").cast("int")).alias("click_share"),
        F.when(F.col("run_index") != 3, F.avg(F.col("value") * F.col("value"))).alias("energy"),
        F.lit(1.0).alias("unit"),
    )


def runs(spark, sf_dir):
    """Stored once: a few rows per run that several passes read."""
    return cut_lineage(inference.per_run_rows(wide_runs(spark, sf_dir), ["condition"], METRICS, BASE))


def paired(spark, sf_dir):
    rows = runs(spark, sf_dir)
    even, odd = (rows.where(F.col("condition") == c) for c in ("even", "odd"))
    both = inference.align_conditions(even, odd, ["metric"])
    return both.where(F.col("paired") & F.col("reference").isNotNull() & F.col("comparison").isNotNull())


def _six(df, *names):
    for name in names:
        df = df.withColumn(name, rounded(name))
    return df


@query("u01_per_run_rows", with_ctes("ru", f"SELECT condition, run_index, seed, metric, {r('value')} AS value FROM ru"))
def per_run_rows(spark, sf_dir):
    return _six(inference.per_run_rows(wide_runs(spark, sf_dir), ["condition"], METRICS, BASE), "value")


cte(
    "ag",
    "SELECT condition, metric, count(*) AS n_runs, CASE WHEN count(value) = count(*) THEN avg(value) END AS mean, CASE WHEN "
    "count(value) = count(*) THEN stddev_pop(value) END AS std FROM ru GROUP BY condition, metric",
    ("ru",),
)


@query(
    "u02_aggregated_runs",
    with_ctes(
        "ag",
        f"SELECT condition, metric, n_runs, {r('mean')} AS mean, {r('std')} AS std, CASE WHEN mean IS NULL THEN 'n/a' ELSE "
        f"printf('%.4f ± %.4f', {r('mean', 4)}, {r('std', 4)}) END AS text FROM ag",
    ),
)
def aggregated_runs(spark, sf_dir):
    out = inference.aggregate_runs(runs(spark, sf_dir), GROUP)
    text = inference.run_text(rounded("mean", 4), rounded("std", 4))
    return _six(out.withColumn("text", text), "mean", "std")


#: Fixed value: two-sided 95 % critical value of Student's t with 7 degrees of freedom.
_T7 = 2.3646242515927849


@query(
    "u03_t_interval",
    with_ctes(
        "ru",
        f"SELECT condition, metric, n AS n_runs, {r('m')} AS mean, {r('s')} AS sample_std, {r('s / sqrt(n)')} AS standard_error, "
        f"{r('lo')} AS min, {r('hi')} AS max, {r(f'm - {_T7} * s / sqrt(n)')} AS lower, {r(f'm + {_T7} * s / sqrt(n)')} AS upper FROM "
        "(SELECT condition, metric, count(*) AS n, count(value) AS c, avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, "
        "max(value) AS hi FROM ru GROUP BY condition, metric) WHERE n = c",
    ),
)
def t_interval(spark, sf_dir):
    out = inference.uncertainty(runs(spark, sf_dir), GROUP)
    return _six(out, "mean", "sample_std", "standard_error", "min", "max", "lower", "upper")


@query(
    "u04_bootstrap_interval",
    with_ctes(
        "ru",
        f"SELECT condition, metric, {r('quantile_cont(m, 0.025)')} AS lower, {r('quantile_cont(m, 0.975)')} AS upper FROM (SELECT "
        f"condition, metric, b, list_sum(list_transform(range({RUNS}), lambda i: v[('0x' || substr(md5('12345|' || b || '|' || i), 1, 8))"
        f"::BIGINT % {RUNS} + 1])) / {RUNS} AS m FROM (SELECT condition, metric, list(value ORDER BY seed) AS v FROM ru GROUP BY "
        "condition, metric HAVING count(value) = count(*)) CROSS JOIN (SELECT unnest(range(10000)) AS b)) GROUP BY condition, metric",
    ),
)
def bootstrap_interval(spark, sf_dir):
    return _six(inference.bootstrap_interval(runs(spark, sf_dir), GROUP), "lower", "upper")


@query(
    "u05_parsed_run_text",
    with_ctes(
        "ag",
        f"SELECT condition, metric, {r('mean', 4)} AS parsed_mean, {r('std', 4)} AS parsed_std FROM ag",
    ),
)
def parsed_run_text(spark, sf_dir):
    out = inference.aggregate_runs(runs(spark, sf_dir), GROUP)
    mean, std = inference.parse_run_text(inference.run_text(rounded("mean", 4), rounded("std", 4)))
    return out.select(*GROUP, rounded(mean, 4).alias("parsed_mean"), rounded(std, 4).alias("parsed_std"))


# --- paired tests ----------------------------------------------------------------------------------


@query(
    "c01_aligned_seeds",
    with_ctes(
        "ru",
        f"SELECT metric, seed, {r('a.value')} AS reference, {r('b.value')} AS comparison, a.x IS NOT NULL AND b.x IS NOT NULL AS paired "
        "FROM (SELECT metric, seed, value, 1 AS x FROM ru WHERE condition = 'even') a FULL JOIN (SELECT metric, seed, value, 1 AS x "
        "FROM ru WHERE condition = 'odd' AND NOT (metric = 'spread' AND run_index = 5)) b USING (metric, seed)",
    ),
)
def aligned_seeds(spark, sf_dir):
    """One run of the second condition is left out and shows as unpaired."""
    rows = runs(spark, sf_dir)
    odd = rows.where((F.col("condition") == "odd") & ~((F.col("metric") == "spread") & (F.col("run_index") == 5)))
    both = inference.align_conditions(rows.where(F.col("condition") == "even"), odd, ["metric"])
    return _six(both, "reference", "comparison")


@query(
    "c02_common_metrics",
    with_ctes(
        "ru",
        f"SELECT condition, metric, count(DISTINCT seed) AS n_seeds FROM ru WHERE value IS NOT NULL GROUP BY condition, metric "
        f"HAVING count(DISTINCT seed) = {RUNS}",
    ),
)
def common_metrics(spark, sf_dir):
    return inference.common_metrics(runs(spark, sf_dir), ["condition"])


cte(
    "dp",
    "SELECT metric, n, m, CASE WHEN cst THEN 0 ELSE s END AS s, cst, zero FROM (SELECT metric, count(*) AS n, avg(d) AS m, "
    "stddev_samp(d) AS s, greatest(max(d) - arg_min(d, seed), arg_min(d, seed) - min(d)) <= 32 * 2.220446049250313e-16 * "
    "greatest(1, max(abs(d))) AS cst, max(abs(d)) <= 32 * 2.220446049250313e-16 * greatest(1, max(abs(d))) AS zero FROM pa "
    "GROUP BY metric)",
    ("pa",),
)
cte(
    "tt",
    "SELECT *, CASE WHEN zero THEN 0 ELSE m / (s / sqrt(n)) END AS t, CASE WHEN zero THEN 0 ELSE m / s END AS dz FROM dp",
    ("dp",),
)
#: t density integrated by Simpson's rule in SQL, against the closed series in the plan.
cte(
    "tp5",
    "SELECT metric, CASE WHEN zero THEN 1 ELSE 1 - 2 * sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * "
    "exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()) * pow(1 + pow(abs(t) * k / 4000, 2) / (n - 1), -n / 2)) * "
    "abs(t) / 12000 END AS p FROM tt CROSS JOIN (SELECT unnest(range(4001))::DOUBLE AS k) GROUP BY metric, zero, n, t",
    ("tt",),
)


@query(
    "c03_difference_profile",
    with_ctes(
        "dp",
        f"SELECT metric, n AS n_pairs, {r('m')} AS mean_difference, {r('s')} AS std_difference, cst AS constant, zero AS all_zero FROM dp",
    ),
)
def difference_profile(spark, sf_dir):
    out = inference.difference_profile(paired(spark, sf_dir), ["metric"])
    return _six(out, "mean_difference", "std_difference")


@query("c04_effect_size", with_ctes("tt", f"SELECT metric, {r('dz')} AS dz FROM tt"))
def effect_size(spark, sf_dir):
    out = inference.effect_size(inference.difference_profile(paired(spark, sf_dir), ["metric"]))
    return out.select("metric", rounded("dz").alias("dz"))


@query(
    "c05_paired_t_test",
    with_ctes("tt tp5", f"SELECT metric, {r('t')} AS t, {r('p')} AS p FROM tt JOIN tp5 USING (metric)"),
)
def paired_t_test(spark, sf_dir):
    out = inference.t_test(inference.difference_profile(paired(spark, sf_dir), ["metric"]))
    return out.select("metric", rounded("t").alias("t"), rounded("p").alias("p"))


#: All 2^n sign choices are listed in SQL, against the rank-by-rank counts in the plan.
cte(
    "wr",
    "SELECT metric, d, rank() OVER (PARTITION BY metric ORDER BY abs(d)) AS rk FROM pa WHERE d <> 0",
    ("pa",),
)
cte(
    "ws",
    "SELECT metric, count(*) AS n, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w FROM wr GROUP BY metric",
    ("wr",),
)
cte(
    "wp",
    "SELECT metric, w, least(1, 2 * avg((total <= w)::INT)) AS p FROM (SELECT ws.metric, ws.w, list_sum(list_transform(range(1, n + 1), "
    "lambda i: i * ((m >> (i - 1)) & 1))) AS total FROM ws CROSS JOIN (SELECT unnest(range(1 << 8)) AS m) WHERE m < (1 << n)) "
    "GROUP BY metric, w",
    ("ws",),
)


@query(
    "c06_signed_rank_test",
    with_ctes(
        "dp wp",
        f"SELECT metric, n AS n_pairs, {r('coalesce(w, 0)')} AS w, {r('coalesce(p, 1)')} AS p FROM dp LEFT JOIN wp USING (metric)",
    ),
)
def signed_rank_test(spark, sf_dir):
    return _six(inference.signed_rank_test(paired(spark, sf_dir), ["metric"]), "w", "p")


#: Critical values of t for 6 and 7 degrees of freedom.
_CRITICAL = f"CASE n WHEN 8 THEN {_T7} ELSE 2.4469118511449692 END"


@query(
    "c07_paired_report",
    with_ctes(
        "pa tt tp5 wp",
        f"SELECT tt.metric, n AS n_pairs, {r('rm')} AS reference_mean, {r('cm')} AS comparison_mean, {r('m')} AS mean_difference, "
        f"{r('s')} AS std_difference, cst AS constant, zero AS all_zero, {r('dz')} AS dz, {r('t')} AS t, {r('tp5.p')} AS p, "
        f"{r(f'm - {_CRITICAL} * s / sqrt(n)')} AS diff_lower, {r(f'm + {_CRITICAL} * s / sqrt(n)')} AS diff_upper, "
        f"{r('coalesce(wp.w, 0)')} AS w, {r('coalesce(wp.p, 1)')} AS p_w FROM tt JOIN tp5 USING (metric) JOIN (SELECT metric, "
        "avg(reference) AS rm, avg(comparison) AS cm FROM pa GROUP BY metric) mm ON mm.metric = tt.metric LEFT JOIN wp ON "
        "wp.metric = tt.metric",
    ),
)
def paired_report(spark, sf_dir):
    out = inference.paired_report(cut_lineage(paired(spark, sf_dir)), ["metric"])
    return _six(
        out, "reference_mean", "comparison_mean", "mean_difference", "std_difference", "dz", "t", "p", "diff_lower", "diff_upper", "w", "p_w"
    )


cte(
    "t8",
    "SELECT user_id AS id, event_type AS family, count(*) AS n, (avg(value) - 50) / nullif(stddev_samp(value) / sqrt(count(*)), 0) AS t "
    "FROM events GROUP BY user_id, event_type",
)
cte(
    "pq8",
    "SELECT id, family, CASE WHEN t IS NOT NULL THEN greatest(0, 1 - 2 * sum((CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * "
    "exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()) * pow(1 + pow(abs(t) * k / 1000, 2) / (n - 1), -n / 2)) * abs(t) / "
    "3000) END AS p FROM (SELECT id, family, n, t FROM t8 WHERE n >= 5 UNION ALL SELECT id, family, 2, NULL FROM t8 WHERE n < 5) CROSS JOIN "
    "(SELECT unnest(range(1001))::DOUBLE AS k) WHERE n >= 5 OR k = 0 GROUP BY id, family, n, t",
    ("t8",),
)
cte(
    "hm",
    "SELECT id, family, p, least(1, max(x) OVER (PARTITION BY family ORDER BY p, id)) AS adj FROM (SELECT *, (count(*) OVER "
    "(PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1) * p AS x FROM pq8 WHERE p IS NOT NULL) "
    "UNION ALL SELECT id, family, p, NULL FROM pq8 WHERE p IS NULL",
    ("pq8",),
)


def _tests(spark, sf_dir):
    """Is a user's mean value of an event type 50? Types are families; groups below five are untested."""
    facts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("family")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s")
    )
    # few bytes and much work: not to be merged into few tasks
    facts = facts.repartition(4 * parallelism(facts.sparkSession), "id", "family")
    t = F.try_divide(F.col("m") - 50, F.col("s") / F.sqrt("n"))
    p = t_two_sided(t, F.greatest(F.col("n") - 1, F.lit(1)))
    return facts.select("id", "family", F.when(F.col("n") >= 5, p).alias("p"))


@query(
    "c08_holm_adjustment",
    with_ctes("hm", f"SELECT id, family, {r('adj')} AS adjusted_p, adj < 0.05 AS reject FROM hm"),
)
def holm_adjustment(spark, sf_dir):
    out = inference.holm(_tests(spark, sf_dir), ["family"], "p", ["id"])
    return out.select("id", "family", rounded("adjusted_p").alias("adjusted_p"), "reject")


@query(
    "c09_significance_marker",
    with_ctes(
        "pq8",
        "SELECT id, family, CASE WHEN p IS NULL THEN 'n/a' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' "
        "ELSE 'n.s.' END AS marker FROM pq8",
    ),
)
def significance_marker(spark, sf_dir):
    return _tests(spark, sf_dir).select("id", "family", inference.significance_marker(F.col("p")).alias("marker"))


# --- drift covariates ------------------------------------------------------------------------------

NAMES = ["elapsed_days", "amplitude_log_ratio", "heart_rate_change"]

cte(
    "d1x",
    "SELECT user_id, CASE WHEN sx > 0 AND sy > 0 AND whole THEN c END AS c FROM (SELECT user_id, corr(x, y) AS c, stddev_pop(x) AS sx, "
    "stddev_pop(y) AS sy, bool_and(x IS NOT NULL AND y IS NOT NULL) AS whole FROM (SELECT user_id, pos, max(value) FILTER "
    "(role = 'enroll') AS x, max(value) FILTER (role = 'probe') AS y FROM avt GROUP BY user_id, pos) GROUP BY user_id)",
    ("avt",),
)
cte(
    "d2x",
    "SELECT user_id, e.days AS elapsed_days, abs(hp - he) AS heart_rate_change, CASE WHEN ae > 0 AND ap > 0 THEN ln(ap / ae) END AS "
    "amplitude_log_ratio, ln(greatest(np, 1) / greatest(ne, 1)) AS record_count_log_ratio FROM (SELECT user_id, max(heart_rate) FILTER "
    "(role = 'enroll') AS he, max(heart_rate) FILTER (role = 'probe') AS hp, max(amplitude) FILTER (role = 'enroll') AS ae, "
    "max(amplitude) FILTER (role = 'probe') AS ap, max(n_records) FILTER (role = 'enroll') AS ne, max(n_records) FILTER "
    "(role = 'probe') AS np FROM ps18 GROUP BY user_id) LEFT JOIN (SELECT user_id, date_diff('day', max(date) FILTER (role = 'enroll'), "
    "min(date) FILTER (role = 'probe'))::INT AS days FROM sul GROUP BY user_id) e USING (user_id) WHERE ne IS NOT NULL AND np IS NOT NULL",
    ("ps18", "sul"),
)
cte("oc", "SELECT user_id, avg(value) AS outcome FROM events WHERE event_type = 'purchase' GROUP BY user_id")
cte(
    "cs",
    "SELECT user_id, outcome AS y, elapsed_days::DOUBLE AS x1, amplitude_log_ratio AS x2, heart_rate_change AS x3, "
    "record_count_log_ratio AS x4 FROM d2x JOIN oc USING (user_id) WHERE elapsed_days IS NOT NULL AND amplitude_log_ratio IS NOT NULL "
    "AND heart_rate_change IS NOT NULL AND outcome IS NOT NULL",
    ("d2x", "oc"),
)


def subject_covariates(spark, sf_dir):
    rows = cut_lineage(signals.weekly(spark, sf_dir))
    statistics = signals.signal.partition_statistics(rows, ["user_id", "role"], ["week"], "date", signals.HR_RATE)
    last = F.max(F.when(F.col("role") == "enroll", F.col("date")))
    first = F.min(F.when(F.col("role") == "probe", F.col("date")))
    bounds = rows.groupBy("user_id").agg(F.date_diff(first, last).alias("elapsed_days"))
    return covariates.subject_covariates(statistics, bounds, "user_id")


def cases(spark, sf_dir):
    scores = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    scores = scores.groupBy("user_id").agg(F.avg("value").alias("outcome"))
    return cut_lineage(covariates.complete_cases(subject_covariates(spark, sf_dir), scores, "user_id", NAMES))


@query("d01_template_drift", with_ctes("d1x", f"SELECT user_id, {r('c')} AS correlation, {r('1 - c')} AS drift FROM d1x"))
def template_drift(spark, sf_dir):
    out = covariates.template_correlation(signals.weekly_templates(spark, sf_dir), "user_id")
    return _six(out, "correlation", "drift")


@query(
    "d02_subject_covariates",
    with_ctes(
        "d2x",
        f"SELECT user_id, elapsed_days, {r('heart_rate_change')} AS heart_rate_change, {r('amplitude_log_ratio')} AS amplitude_log_ratio, "
        f"{r('record_count_log_ratio')} AS record_count_log_ratio FROM d2x",
    ),
)
def covariate_rows(spark, sf_dir):
    return _six(subject_covariates(spark, sf_dir), "heart_rate_change", "amplitude_log_ratio", "record_count_log_ratio")


def _average_rank(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2"


_RANKED = ", ".join(f"{_average_rank(c)} AS r{c}" for c in ("y", "x1", "x2", "x3"))
_UNIVARIATE = " UNION ALL ".join(
    f"SELECT '{name}' AS covariate, count(*) AS n, max(x{i}) - min(x{i}) <= 1e-8 + 1e-5 * max(abs(x{i})) AS constant, CASE WHEN "
    f"max(x{i}) - min(x{i}) > 1e-8 + 1e-5 * max(abs(x{i})) THEN {r(f'corr(rx{i}, ry)')} END AS spearman, CASE WHEN max(x{i}) - min(x{i}) > "
    f"1e-8 + 1e-5 * max(abs(x{i})) THEN {r(f'corr(x{i}, y)')} END AS pearson FROM (SELECT *, {_RANKED} FROM cs)"
    for i, name in enumerate(NAMES, 1)
)


@query("d03_univariate_association", with_ctes("cs", _UNIVARIATE))
def univariate_association(spark, sf_dir):
    out = covariates.univariate(cases(spark, sf_dir), NAMES)
    return _six(out, "spearman", "pearson").drop("spearman_p", "pearson_p")


_RAW = " UNION ALL ".join(
    f"SELECT '{name}' AS covariate, count(*) AS n, corr(rx{i}, ry) AS rho, corr(x{i}, y) AS r FROM (SELECT *, {_RANKED} FROM cs)"
    for i, name in enumerate(NAMES, 1)
)
cte("rawc", _RAW, ("cs",))


def _p_in_sql(value: str) -> str:
    """t density with n - 2 degrees of freedom, integrated by Simpson's rule."""
    t = f"abs({value} * sqrt((n - 2) / (1 - {value} * {value})))"
    return (
        "1 - 2 * sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / "
        f"sqrt((n - 2) * pi()) * pow(1 + pow({t} * k / 2000, 2) / (n - 2), -(n - 1) / 2) * {t} / 6000)"
    )


@query(
    "d03_association_p_values",
    with_ctes(
        "rawc",
        f"SELECT covariate, {r(_p_in_sql('rho'))} AS spearman_p, {r(_p_in_sql('r'))} AS pearson_p FROM rawc CROSS JOIN "
        "(SELECT unnest(range(2001))::DOUBLE AS k) GROUP BY covariate",
    ),
)
def association_p_values(spark, sf_dir):
    out = covariates.univariate(cases(spark, sf_dir), NAMES)
    return _six(out, "spearman_p", "pearson_p").select("covariate", "spearman_p", "pearson_p")


cte(
    "cm3",
    "SELECT count(*) AS n, avg(y) AS my, stddev_pop(y) AS sy, corr(x1, x2) AS a, corr(x1, x3) AS b, corr(x2, x3) AS c, corr(x1, y) AS p, "
    "corr(x2, y) AS q, corr(x3, y) AS s FROM cs",
    ("cs",),
)
cte("cm4", "SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM cm3", ("cm3",))
_BETA = (
    "sy * (p * (1 - c * c) + q * (b * c - a) + s * (a * c - b)) / det",
    "sy * (p * (b * c - a) + q * (1 - b * b) + s * (a * b - c)) / det",
    "sy * (p * (a * c - b) + q * (a * b - c) + s * (1 - a * a)) / det",
)
_R2 = f"(p * ({_BETA[0]}) + q * ({_BETA[1]}) + s * ({_BETA[2]})) / sy"


@query(
    "d04_joint_model",
    with_ctes(
        "cm4",
        " UNION ALL ".join(
            f"SELECT '{name}' AS covariate, {r(beta, 5)} AS coefficient, {r('my', 5)} AS intercept, {r(_R2)} AS r_squared, "
            f"{r(f'1 - (1 - {_R2}) * (n - 1) / (n - 4)')} AS adjusted_r_squared, n FROM cm4"
            for name, beta in zip(NAMES, _BETA)
        ),
    ),
)
def joint_model(spark, sf_dir):
    out = covariates.joint_model(cases(spark, sf_dir), NAMES).drop("vif")
    out = _six(out, "r_squared", "adjusted_r_squared")
    return out.withColumn("coefficient", rounded("coefficient", 5)).withColumn("intercept", rounded("intercept", 5))


@query(
    "d05_variance_inflation",
    with_ctes(
        "cm4",
        " UNION ALL ".join(
            f"SELECT '{name}' AS covariate, {r(f'(1 - {x} * {x}) / det')} AS vif FROM cm4" for name, x in zip(NAMES, "cba")
        ),
    ),
)
def variance_inflation(spark, sf_dir):
    return _six(covariates.joint_model(cases(spark, sf_dir), NAMES).select("covariate", "vif"), "vif")


# --- result tables ---------------------------------------------------------------------------------

IDENTITY = ["dataset", "protocol", "setting"]
cte(
    "ct",
    "SELECT DISTINCT event_type AS dataset, 'u' || (user_id % 3) AS protocol, unnest(['closed', 'open']) AS setting FROM events",
)
cte(
    "rs",
    "SELECT event_type AS dataset, 'u' || (user_id % 4) AS protocol, CASE WHEN event_id % 2 = 0 THEN 'closed' ELSE 'open' END AS setting, "
    "'rate' AS metric, avg(value) AS value FROM events GROUP BY ALL UNION ALL SELECT event_type, 'u' || (user_id % 4), CASE WHEN "
    "event_id % 2 = 0 THEN 'closed' ELSE 'open' END, 'count', count(*) FROM events WHERE event_type <> 'view' GROUP BY ALL UNION ALL "
    "SELECT event_type, 'u1', 'open', 'rate', 0 FROM events WHERE event_type = 'error' GROUP BY ALL",
)


def _catalogue(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    keys = events.select(F.col("event_type").alias("dataset"), F.concat(F.lit("u"), F.col("user_id") % 3).alias("protocol")).distinct()
    return keys.withColumn("setting", F.explode(F.array(F.lit("closed"), F.lit("open"))))


def _results(spark, sf_dir):
    """Rates and counts per entry; one dataset has no counts and one entry has two rates."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset"),
        F.concat(F.lit("u"), F.col("user_id") % 4).alias("protocol"),
        F.when(F.col("event_id") % 2 == 0, "closed").otherwise("open").alias("setting"),
        "value",
    )
    both = events.groupBy(*IDENTITY).agg(F.avg("value").alias("rate"), F.count(F.lit(1)).cast("double").alias("count"))
    long = both.unpivot(IDENTITY, ["rate", "count"], "metric", "value")
    long = long.where((F.col("metric") == "rate") | (F.col("dataset") != "view"))
    twice = events.where(F.col("dataset") == "error").select("dataset").distinct().select(
        "dataset", F.lit("u1").alias("protocol"), F.lit("open").alias("setting"), F.lit("rate").alias("metric"), F.lit(0.0).alias("value")
    )
    return long.unionByName(twice)


@query(
    "x01_result_table",
    with_ctes(
        "ct rs",
        f"SELECT ct.*, {r('rate')} AS rate, {r('cnt')} AS count, rate IS NULL OR cnt IS NULL AS missing FROM ct LEFT JOIN (SELECT dataset, "
        "protocol, setting, max(v) FILTER (metric = 'rate') AS rate, max(v) FILTER (metric = 'count') AS cnt FROM (SELECT dataset, protocol, "
        "setting, metric, max(value) AS v FROM rs GROUP BY dataset, protocol, setting, metric HAVING count(*) = 1) GROUP BY dataset, "
        "protocol, setting) USING (dataset, protocol, setting)",
    ),
)
def result_table(spark, sf_dir):
    out = tables.result_table(_catalogue(spark, sf_dir), _results(spark, sf_dir), IDENTITY, ["rate", "count"])
    return _six(out, "rate", "count")


@query(
    "x01_missing_results",
    with_ctes(
        "ct rs",
        "SELECT * FROM ct WHERE (dataset, protocol, setting) NOT IN (SELECT (dataset, protocol, setting) FROM rs WHERE metric = 'count')",
    ),
)
def missing_results(spark, sf_dir):
    counted = _results(spark, sf_dir).where(F.col("metric") == "count")
    return tables.missing_results(_catalogue(spark, sf_dir), counted, IDENTITY)


@query(
    "x02_coverage",
    with_ctes(
        "ct rs",
        "SELECT dataset, protocol, count(c) AS n_expected, count_if(c IS NOT NULL AND q IS NOT NULL)::BIGINT AS n_found, "
        "count_if(c IS NULL)::BIGINT AS n_surplus, count_if(q IS NULL)::BIGINT AS n_missing FROM (SELECT *, 1 AS c FROM ct) a FULL JOIN "
        "(SELECT DISTINCT dataset, protocol, setting, 1 AS q FROM rs WHERE metric = 'count') b USING (dataset, protocol, setting) "
        "GROUP BY ROLLUP (dataset, protocol)",
    ),
)
def coverage(spark, sf_dir):
    counted = _results(spark, sf_dir).where(F.col("metric") == "count")
    return tables.coverage(_catalogue(spark, sf_dir), counted, IDENTITY, ["dataset", "protocol"])


@query(
    "x03_complete_series",
    with_ctes(
        "ru",
        f"SELECT condition, metric, count(*) AS n_runs, {r('avg(value)')} AS mean FROM ru GROUP BY condition, metric HAVING "
        f"count(value) = count(*) AND count(DISTINCT seed) = {RUNS}",
    ),
)
def complete_series(spark, sf_dir):
    return _six(tables.complete_series(runs(spark, sf_dir), GROUP, RUNS), "mean")
