"""1:1 comparisons and error curves on the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from probeline.functions.columns import prepared, rounded, rounded_many
from probeline.functions.ordering import numbered
from probeline.operators import comparisons, fusion, moments, verification
from probeline.operators.classifier import classifier_scores
from probeline.operators.comparisons import RankSpace
from probeline.operators.filters import encode_labels
from probeline.operators.refined import RefinedComparison, decisions_at
from probeline.operators.scoring import grid_scores
from probeline.plans import matching
from probeline.plans.registry import cte, query, r, table, with_ctes
from probeline.session import cut_lineage

SEED = 42

cte(
    "ap",
    "SELECT a.vec_id AS a_id, b.vec_id AS b_id, (a.label = b.label)::INT AS is_genuine, "
    "list_dot_product(a.n, b.n) AS score FROM u a JOIN u b ON a.vec_id < b.vec_id",
    ("u",),
)
cte("hs", "SELECT score, sum(is_genuine) AS g, sum(1 - is_genuine) AS i FROM ap GROUP BY score", ("ap",))
cte(
    "cv",
    "SELECT score AS threshold, g, i, (sum(g) OVER w / sum(g) OVER ())::DOUBLE AS tar, "
    "(sum(i) OVER w / sum(i) OVER ())::DOUBLE AS far, ((sum(g) OVER w - g) / sum(g) OVER ())::DOUBLE AS tar0, "
    "((sum(i) OVER w - i) / sum(i) OVER ())::DOUBLE AS far0 FROM hs WINDOW w AS (ORDER BY score DESC)",
    ("hs",),
)
cte(
    "ps",
    "SELECT vec_id AS id, label, row_number() OVER (ORDER BY md5('label|' || label), label, "
    "md5('row|' || vec_id), vec_id) - 1 AS pos FROM embeddings",
)
cte(
    "pu",
    "SELECT least(a.id, b.id) AS a_id, greatest(a.id, b.id) AS b_id, (a.label = b.label)::INT AS is_genuine, "
    "row_number() OVER (PARTITION BY a.label = b.label ORDER BY a.pos, b.pos) - 1 AS rank_in_class, "
    "row_number() OVER (ORDER BY a.pos, b.pos) - 1 AS rank_any FROM ps a JOIN ps b ON a.pos < b.pos",
    ("ps",),
)


def draws(seed: int, universe: str, wanted: int) -> str:
    """Images of 0 to ``wanted`` - 1 under the keyed permutation of the universe."""
    step = "SELECT k, n, u, a, b, x // b AS i, x % b AS j FROM w, z WHERE n = 0 OR x >= u"
    for k in range(comparisons.MIXING_ROUNDS):
        place, given, size = ("i", "j", "a") if k % 2 == 0 else ("j", "i", "b")
        added = f"('0x' || substr(md5('{seed}|{k}|' || {given}), 1, 15))::BIGINT"
        other = f"{given}, ({place} + {added}) % {size} AS {place}"
        step = f"SELECT k, n, u, a, b, {other} FROM ({step})"
    return (
        f"(WITH RECURSIVE z AS (SELECT u, a, ceil(u / a)::BIGINT AS b FROM (SELECT u, ceil(sqrt(u))::BIGINT AS a FROM "
        f"(SELECT {universe}::BIGINT AS u))), w(k, x, n) AS (SELECT k, k, 0 FROM range({wanted}) t(k) UNION ALL "
        f"SELECT k, i * b + j, n + 1 FROM ({step})) SELECT x AS rank FROM w, z WHERE n > 0 AND x < u)"
    )


def sampled(source: str, genuine: int | None, seed: int, wanted: int) -> str:
    if genuine is None:
        size, on, where = f"(SELECT count(*) FROM {source})", "rank_any", ""
    else:
        size = f"(SELECT count(*) FROM {source} WHERE is_genuine = {genuine})"
        on, where = "rank_in_class", f" AND p.is_genuine = {genuine}"
    return (
        f"SELECT a_id, b_id, is_genuine FROM {source} p JOIN {draws(seed, size, wanted)} d "
        f"ON p.{on} = d.rank{where}"
    )


@query(
    "e14_all_pairs",
    with_ctes("ap", f"SELECT a_id, b_id, is_genuine, {r('score')} AS score FROM ap"),
)
def all_pairs(spark, sf_dir):
    scored = grid_scores(matching.vectors(spark, sf_dir), None)
    return scored.select(
        "a_id", "b_id", (F.col("a_label") == F.col("b_label")).cast("int").alias("is_genuine"), rounded_many("score").alias("score")
    )


@query(
    "e15_all_cells",
    with_ctes(
        "s",
        f"SELECT p.vec_id AS a_id, t.vec_id AS b_id, (p.label = t.label)::INT AS is_genuine, "
        f"{r('list_dot_product(p.n, t.n)')} AS score FROM s p CROSS JOIN s t WHERE p.role = 'probe' "
        "AND t.role = 'enroll'",
    ),
)
def all_cells(spark, sf_dir):
    enrolled, probes = matching.enroll_and_probe(spark, sf_dir)
    scored = grid_scores(probes, enrolled)
    return scored.select(
        "a_id", "b_id", (F.col("a_label") == F.col("b_label")).cast("int").alias("is_genuine"), rounded("score").alias("score")
    )


@query(
    "e16_genuine_pairs",
    with_ctes("ap", f"SELECT a_id, b_id, {r('score')} AS score FROM ap WHERE is_genuine = 1"),
)
def genuine_pairs(spark, sf_dir):
    scored = comparisons.score_genuine_pairs(matching.vectors(spark, sf_dir))
    return scored.select("a_id", "b_id", rounded_many("score").alias("score"))


IMPOSTORS = 10_000
BUDGET = 2_000


def _space(spark: SparkSession, sf_dir: str) -> RankSpace:
    return RankSpace(matching.vectors(spark, sf_dir).select("id", "label"))


@query("e17_impostor_sample", with_ctes("pu", sampled("pu", 0, SEED, IMPOSTORS)))
def impostor_sample(spark, sf_dir):
    return _space(spark, sf_dir).sample_impostors(IMPOSTORS, SEED)


@query(
    "e18_all_genuine_mode",
    with_ctes(
        "pu",
        "SELECT a_id, b_id, is_genuine FROM pu WHERE is_genuine = 1 UNION ALL "
        + sampled("pu", 0, SEED, IMPOSTORS),
    ),
)
def all_genuine_mode(spark, sf_dir):
    return _space(spark, sf_dir).select("all_genuine", IMPOSTORS, SEED)


_BALANCED = sampled("pu", 1, SEED, BUDGET // 2) + " UNION ALL " + sampled("pu", 0, SEED + 1, BUDGET // 2)


@query("e19_balanced_mode", with_ctes("pu", _BALANCED))
def balanced_mode(spark, sf_dir):
    return _space(spark, sf_dir).select("balanced", BUDGET, SEED)


@query("e20_random_mode", with_ctes("pu", sampled("pu", None, SEED, BUDGET)))
def random_mode(spark, sf_dir):
    return _space(spark, sf_dir).select("random", BUDGET, SEED)


@query(
    "e21_rank_to_pair",
    "WITH p AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings), "
    "q AS (SELECT vec_id, n, pos AS i, lead(pos) OVER (PARTITION BY label ORDER BY vec_id) AS j FROM p), "
    "k AS (SELECT *, i * n - i * (i + 1) // 2 + j - i - 1 AS rank FROM q WHERE j IS NOT NULL) "
    "SELECT vec_id, rank, i AS back_i, j AS back_j, rank // n AS grid_row, rank % n AS grid_col FROM k",
)
def rank_to_pair(spark, sf_dir):
    """Each row and the next one of its label as a rank of the unordered universe, and back to positions."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    size = F.lit(rows.count()).cast("bigint")
    bucket = F.floor(F.col("vec_id") / 4096)
    placed = numbered(rows, [], ["vec_id"], bucket, "at")
    placed = numbered(placed, ["label"], ["vec_id"], bucket, "turn")
    following = placed.select("label", (F.col("turn") - 1).alias("turn"), (F.col("at") - 1).alias("j"))
    pairs = placed.join(following, ["label", "turn"]).withColumn("i", F.col("at") - 1)
    ranked = pairs.select("vec_id", comparisons.triangle_rank(F.col("i"), F.col("j"), size).alias("rank"))
    i, j = comparisons.triangle_pair(F.col("rank"), size)
    row, column = comparisons.cartesian_pair(F.col("rank"), size)
    return ranked.select("vec_id", "rank", i.alias("back_i"), j.alias("back_j"), row.alias("grid_row"), column.alias("grid_col"))


@query(
    "e22_selected_pair_scores",
    with_ctes(
        "pu ap",
        f"SELECT ap.a_id, ap.b_id, ap.is_genuine, {r('ap.score')} AS score FROM ({_BALANCED}) x JOIN ap "
        "ON ap.a_id = x.a_id AND ap.b_id = x.b_id",
    ),
)
def selected_pair_scores(spark, sf_dir):
    vectors = matching.vectors(spark, sf_dir)
    pairs = _space(spark, sf_dir).select("balanced", BUDGET, SEED)
    scored = comparisons.score_selected(pairs, vectors, vectors)
    return scored.withColumn("score", rounded("score"))


# --- fused decisions -------------------------------------------------------------------------------

GROUP_BUDGET = 50

cte("gid", "SELECT *, label || '-' || session || '-' || group_no AS group_id FROM gr", ("gr",))
cte(
    "gp",
    "SELECT group_id, label, row_number() OVER (ORDER BY md5('label|' || label), label, md5('row|' || group_id), "
    "group_id) - 1 AS pos FROM (SELECT DISTINCT group_id, label FROM gid)",
    ("gid",),
)
cte(
    "tp",
    "SELECT DISTINCT label, dense_rank() OVER (ORDER BY md5('label|' || label), label) - 1 AS pos FROM embeddings",
)
cte(
    "gu",
    "SELECT a.group_id AS a_id, b.label AS b_id, (a.label = b.label)::INT AS is_genuine, row_number() OVER "
    "(PARTITION BY a.label = b.label ORDER BY a.pos, b.pos) - 1 AS rank_in_class, row_number() OVER "
    "(ORDER BY a.pos, b.pos) - 1 AS rank_any FROM gp a CROSS JOIN tp b",
    ("gp", "tp"),
)
cte(
    "fs",
    "SELECT gid.group_id, gid.label, sc.identity, avg(sc.score) AS score FROM gid JOIN sc "
    "ON gid.vec_id = sc.probe_id GROUP BY ALL",
    ("gid", "sc"),
)
cte("kt", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS tno FROM u) WHERE tno <= 3", ("u",))
cte(
    "ms",
    "SELECT group_id, label, identity, max(m) AS score FROM (SELECT g.group_id, g.label, t.label AS identity, t.tno, "
    "avg(list_dot_product(u.n, t.n)) AS m FROM gid g JOIN u USING (vec_id) CROSS JOIN kt t GROUP BY ALL) GROUP BY ALL",
    ("gid", "u", "kt"),
)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = matching.grouped_probes(spark, sf_dir).select(
        "id", "label", F.concat_ws("-", "label", "session", "group_no").alias("group_id")
    )
    vectors = matching.vectors(spark, sf_dir).select("id", "vec")
    return cut_lineage(groups.join(vectors, "id"))


def _group_space(members: DataFrame, templates: DataFrame) -> RankSpace:
    groups = members.select(F.col("group_id").alias("id"), "label").distinct()
    identities = templates.select(F.col("identity").alias("id"), F.col("identity").alias("label")).distinct()
    return RankSpace(groups, identities)


def _one_template(spark, sf_dir):
    return matching.gallery(spark, sf_dir).select(
        F.col("label").alias("identity"), F.lit(1).alias("template_no"), "vec"
    )


def _several_templates(spark, sf_dir):
    kept = matching.templates.first_per_key(matching.vectors(spark, sf_dir), ["label"], ["id"], 3)
    return kept.select(F.col("label").alias("identity"), F.col("id").alias("template_no"), "vec")


def _group_decisions(spark, sf_dir, templates, mode, budget):
    members = _members(spark, sf_dir)
    pairs = _group_space(members, templates).select(mode, budget, SEED)
    scored = comparisons.score_group_decisions(pairs, members, templates)
    return scored.select(
        F.col("a_id").alias("group_id"), F.col("b_id").alias("identity"), "is_genuine", rounded("score").alias("score")
    )


def _all_decisions(members, templates):
    fused = fusion.fused_scores(
        members.select("id", F.struct("group_id", "label").alias("g"), "vec").select("id", F.to_json("g").alias("group"), "vec"),
        templates.select(F.col("template_no").alias("id"), "identity", "vec"),
    )
    own = F.from_json("group", "group_id string, label int")
    return fused.select(
        own["group_id"].alias("group_id"),
        "identity",
        (own["label"] == F.col("identity")).cast("int").alias("is_genuine"),
        rounded("score").alias("score"),
    )


def _sampled_groups(source: str, sample: str) -> str:
    return (
        f"SELECT x.a_id AS group_id, x.b_id AS identity, x.is_genuine, {r('f.score')} AS score FROM ({sample}) x "
        f"JOIN {source} f ON f.group_id = x.a_id AND f.identity = x.b_id"
    )


_ALL_GENUINE_GROUPS = (
    "SELECT a_id, b_id, is_genuine FROM gu WHERE is_genuine = 1 UNION ALL " + sampled("gu", 0, SEED, 200)
)


@query(
    "e23_fused_all",
    with_ctes(
        "fs", f"SELECT group_id, identity, (label = identity)::INT AS is_genuine, {r('score')} AS score FROM fs"
    ),
)
def fused_all(spark, sf_dir):
    return _all_decisions(_members(spark, sf_dir), _one_template(spark, sf_dir))


@query("e23_fused_all_genuine", with_ctes("gu fs", _sampled_groups("fs", _ALL_GENUINE_GROUPS)))
def fused_all_genuine(spark, sf_dir):
    return _group_decisions(spark, sf_dir, _one_template(spark, sf_dir), "all_genuine", 200)


@query(
    "e23_fused_balanced",
    with_ctes(
        "gu fs",
        _sampled_groups(
            "fs",
            sampled("gu", 1, SEED, GROUP_BUDGET // 2) + " UNION ALL " + sampled("gu", 0, SEED + 1, GROUP_BUDGET // 2),
        ),
    ),
)
def fused_balanced(spark, sf_dir):
    return _group_decisions(spark, sf_dir, _one_template(spark, sf_dir), "balanced", GROUP_BUDGET)


@query("e23_fused_random", with_ctes("gu fs", _sampled_groups("fs", sampled("gu", None, SEED, GROUP_BUDGET))))
def fused_random(spark, sf_dir):
    return _group_decisions(spark, sf_dir, _one_template(spark, sf_dir), "random", GROUP_BUDGET)


@query(
    "e24_multi_template_all",
    with_ctes(
        "ms", f"SELECT group_id, identity, (label = identity)::INT AS is_genuine, {r('score')} AS score FROM ms"
    ),
)
def multi_template_all(spark, sf_dir):
    """Three templates per identity: mean over the group per template, then the best template."""
    return _all_decisions(_members(spark, sf_dir), _several_templates(spark, sf_dir))


@query(
    "e24_multi_template_all_genuine",
    with_ctes("gu ms", _sampled_groups("ms", _ALL_GENUINE_GROUPS)),
)
def multi_template_all_genuine(spark, sf_dir):
    return _group_decisions(spark, sf_dir, _several_templates(spark, sf_dir), "all_genuine", 200)


@query(
    "e24_multi_template_balanced",
    with_ctes(
        "gu ms",
        _sampled_groups(
            "ms",
            sampled("gu", 1, SEED, GROUP_BUDGET // 2) + " UNION ALL " + sampled("gu", 0, SEED + 1, GROUP_BUDGET // 2),
        ),
    ),
)
def multi_template_balanced(spark, sf_dir):
    return _group_decisions(spark, sf_dir, _several_templates(spark, sf_dir), "balanced", GROUP_BUDGET)


@query(
    "e24_multi_template_random",
    with_ctes("gu ms", _sampled_groups("ms", sampled("gu", None, SEED, GROUP_BUDGET))),
)
def multi_template_random(spark, sf_dir):
    return _group_decisions(spark, sf_dir, _several_templates(spark, sf_dir), "random", GROUP_BUDGET)


@query("e25_classifier_scores")
def classifier(spark, sf_dir):
    enrolled, probes = matching.enroll_and_probe(spark, sf_dir)
    codes = encode_labels(enrolled.select("label").distinct(), "label")
    scored = classifier_scores(enrolled, probes, codes)
    return scored.withColumn("score", rounded("score", 4))


# --- curves and metrics ----------------------------------------------------------------------------


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir).full_curve()


def _refined(spark: SparkSession, sf_dir: str) -> RefinedComparison:
    return RefinedComparison(matching.vectors(spark, sf_dir))


@query(
    "m04_roc_curve",
    with_ctes(
        "cv",
        f"SELECT {r('threshold')} AS threshold, {r('far')} AS far, {r('tar')} AS tar, {r('1 - tar')} AS frr FROM cv "
        "UNION ALL SELECT NULL, 0, 0, 1",
    ),
)
def roc_curve(spark, sf_dir):
    points = verification.roc_points(curve(spark, sf_dir))
    return points.select(*[rounded_many(c).alias(c) for c in ("threshold", "far", "tar", "frr")])


@query(
    "m05_det_curve",
    with_ctes("cv", f"SELECT {r('threshold')} AS threshold, {r('far')} AS far, {r('1 - tar')} AS frr FROM cv"),
)
def det_curve(spark, sf_dir):
    points = verification.det_points(curve(spark, sf_dir))
    return points.select(*[rounded_many(c).alias(c) for c in ("threshold", "far", "frr")])


_EER = (
    "SELECT coalesce(min_by(far, -threshold) FILTER (far - (1 - tar) = 0), "
    "min_by(0.5 * (far0 + f * (far - far0) + (1 - tar0) + f * ((1 - tar) - (1 - tar0))), -threshold) FILTER "
    "((far - (1 - tar)) * (far0 - (1 - tar0)) < 0)) AS eer, sum((far - far0) * (tar + tar0) / 2) AS auc FROM "
    "(SELECT *, -(far0 - (1 - tar0)) / ((far - (1 - tar)) - (far0 - (1 - tar0))) AS f FROM cv)"
)


@query("m06_equal_error_rate", with_ctes("cv", f"SELECT {r('eer')} AS eer FROM ({_EER})"))
def equal_error_rate(spark, sf_dir):
    return verification.curve_summary(_refined(spark, sf_dir).curve()).select(rounded("eer").alias("eer"))


@query("m07_area_under_curve", with_ctes("cv", f"SELECT {r('auc')} AS auc FROM ({_EER})"))
def area_under_curve(spark, sf_dir):
    return _refined(spark, sf_dir).area_to(6).select(rounded("auc").alias("auc"))


@query(
    "m08_operating_points",
    with_ctes(
        "cv",
        f"SELECT target_far, {r('o.far')} AS observed_far, {r('o.tar')} AS tar, {r('o.threshold')} AS threshold, "
        f"1 / imp <= target_far AS resolvable, CASE WHEN 1 / imp <= target_far THEN {r('o.tar')} END AS tar_reported "
        "FROM (SELECT t.target_far, (SELECT sum(i) FROM cv) AS imp, (SELECT struct_pack(far := far, tar := tar, "
        "threshold := threshold) FROM (SELECT far, tar, threshold FROM cv UNION ALL SELECT 0, 0, NULL) c WHERE "
        "c.far <= t.target_far + 32 * 2.220446049250313e-16 ORDER BY tar DESC, far, threshold DESC NULLS FIRST "
        "LIMIT 1) AS o FROM (VALUES (0.1::DOUBLE), (0.01::DOUBLE), (0.001::DOUBLE), (0.0001::DOUBLE)) t(target_far))",
    ),
)
def operating_points(spark, sf_dir):
    points = verification.operating_points(_refined(spark, sf_dir).curve())
    return points.select(
        "target_far", "resolvable", *[rounded(c).alias(c) for c in ("observed_far", "tar", "threshold", "tar_reported")]
    )


@query(
    "m09_d_prime",
    with_ctes(
        "ap",
        f"SELECT {r('mg')} AS genuine_mean, {r('mi')} AS impostor_mean, "
        f"{r('abs(mg - mi) / sqrt(0.5 * (vg + vi) + 1e-10)')} AS d_prime FROM (SELECT avg(score) FILTER "
        "(is_genuine = 1) AS mg, avg(score) FILTER (is_genuine = 0) AS mi, var_pop(score) FILTER (is_genuine = 1) "
        "AS vg, var_pop(score) FILTER (is_genuine = 0) AS vi FROM ap)",
    ),
)
def d_prime(spark, sf_dir):
    out = _refined(spark, sf_dir).d_prime()
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(
    "m10_pair_summary",
    with_ctes(
        "ap",
        f"SELECT n_total, g AS n_genuine, i AS n_impostor, {r('1 / i', 9)} AS smallest_far, 1 / i <= 0.001 AS "
        "resolvable FROM (SELECT count(*) AS n_total, count_if(is_genuine = 1)::BIGINT AS g, "
        "count_if(is_genuine = 0)::BIGINT AS i FROM ap)",
    ),
)
def pair_summary(spark, sf_dir):
    out = verification.pair_summary(_refined(spark, sf_dir).pair_counts())
    return out.withColumn("smallest_far", rounded("smallest_far", 9))


@query(
    "m11_calibration_threshold",
    with_ctes(
        "cv",
        f"SELECT {r('threshold')} AS threshold FROM cv ORDER BY abs((1 - tar) - far), cv.threshold DESC LIMIT 1",
    ),
)
def calibration_threshold(spark, sf_dir):
    points = _refined(spark, sf_dir).curve()
    return verification.calibration_threshold(points).select(rounded("threshold").alias("threshold"))


@query(
    "m12_frozen_threshold",
    with_ctes(
        "s",
        f"SELECT {r('thr')} AS threshold, {r('avg(((score >= thr) = (is_genuine = 1))::INT)')} AS accuracy, "
        f"{r('avg((score >= thr)::INT) FILTER (is_genuine = 0)')} AS far, "
        f"{r('avg((score < thr)::INT) FILTER (is_genuine = 1)')} AS frr FROM ("
        "SELECT list_dot_product(a.n, b.n) AS score, (a.label = b.label)::INT AS is_genuine FROM s a JOIN s b "
        "ON a.vec_id < b.vec_id WHERE a.role = 'probe' AND b.role = 'probe') p CROSS JOIN ("
        "SELECT threshold AS thr FROM (SELECT score AS threshold, sum(g) OVER w / sum(g) OVER () AS tar, sum(i) OVER w "
        "/ sum(i) OVER () AS far FROM (SELECT score, sum(is_genuine) AS g, sum(1 - is_genuine) AS i FROM ("
        "SELECT list_dot_product(a.n, b.n) AS score, (a.label = b.label)::INT AS is_genuine FROM s a JOIN s b "
        "ON a.vec_id < b.vec_id WHERE a.role = 'enroll' AND b.role = 'enroll') GROUP BY score) "
        "WINDOW w AS (ORDER BY score DESC)) ORDER BY abs((1 - tar) - far), threshold DESC LIMIT 1) GROUP BY thr",
    ),
)
def frozen_threshold(spark, sf_dir):
    """Threshold from enrollment pairs, applied to probe pairs."""
    enrolled, probes = matching.enroll_and_probe(spark, sf_dir)
    threshold = cut_lineage(verification.calibration_threshold(RefinedComparison(enrolled).curve()))
    decisions = decisions_at(probes, None, threshold.first()["threshold"])
    out = verification.apply_threshold(decisions, threshold)
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(
    "m13_decision_problems",
    with_ctes(
        "ap",
        "SELECT count_if(score IS NULL OR isnan(score) OR isinf(score))::BIGINT AS n_not_finite, "
        "count_if(is_genuine NOT IN (0, 1))::BIGINT AS n_not_binary, count_if(is_genuine = 1)::BIGINT AS n_genuine, "
        "count_if(is_genuine = 0)::BIGINT AS n_impostor FROM ap",
    ),
)
def decision_problems(spark, sf_dir):
    vectors = matching.vectors(spark, sf_dir)
    ready = vectors.select("id", "label", prepared(F.col("vec"), "cosine").alias("vec"))
    return verification.comparison_problems(moments.problem_counts(ready))


@query(
    "m14_confusion_matrix",
    with_ctes(
        "sc",
        "SELECT true_identity, predicted, count(*) AS n, "
        f"{r('count(*) / sum(count(*)) OVER (PARTITION BY true_identity)')} AS share FROM (SELECT probe_id, true_identity, arg_min(identity, (-score, "
        "identity)) AS predicted FROM sc GROUP BY probe_id, true_identity) GROUP BY true_identity, predicted",
    ),
)
def confusion_matrix(spark, sf_dir):
    _, probes = matching.enroll_and_probe(spark, sf_dir)
    best = grid_scores(probes, matching.gallery(spark, sf_dir), output="best")
    cells = verification.confusion(verification.nearest_identity(best, probes))
    return cells.withColumn("share", rounded("share"))
