"""Templates, 1:N scores, fusion and identification on the ``embeddings`` table.

Study setting: the first ten vectors of a label (by id) enroll, all others probe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from probeline.functions.columns import as_double_array, prepared, rounded, similarity
from probeline.operators import fusion, identification, splits, templates
from probeline.operators.scoring import grid_scores
from probeline.plans.registry import cte, query, r, table, with_ctes
from probeline.session import cut_lineage

ENROLL = 10
K_GROUP = 3
K_TEMPLATES = 3

cte("v", "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings")
cte("u", "SELECT *, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-10)) AS n FROM v", ("v",))
cte(
    "s",
    f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY vec_id) <= {ENROLL} "
    "THEN 'enroll' ELSE 'probe' END AS role FROM u",
    ("u",),
)
cte(
    "en",
    "SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM s WHERE role = 'enroll'",
    ("s",),
)
cte("tm", "SELECT label, pos, avg(x) AS m FROM en GROUP BY label, pos", ("en",))
cte("tv", "SELECT label AS identity, list(m ORDER BY pos) AS t FROM tm GROUP BY label", ("tm",))
cte(
    "tn",
    "SELECT identity, list_transform(t, lambda x: x / (sqrt(list_dot_product(t, t)) + 1e-10)) AS t FROM tv",
    ("tv",),
)
cte(
    "sc",
    "SELECT p.vec_id AS probe_id, p.label AS true_identity, t.identity, list_dot_product(p.n, t.t) AS score "
    "FROM s p CROSS JOIN tn t WHERE p.role = 'probe'",
    ("s", "tn"),
)
cte(
    "rk",
    "SELECT a.probe_id, a.true_identity, count(*) AS rnk FROM sc a JOIN sc g ON a.probe_id = g.probe_id "
    "AND g.identity = g.true_identity WHERE a.score >= g.score GROUP BY ALL",
    ("sc",),
)
cte(
    "ce",
    "SELECT s.vec_id, s.label, s.e, list_dot_product(s.w, d.w) - 1 AS c FROM "
    "(SELECT vec_id, label, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS w FROM s "
    "WHERE role = 'enroll') s JOIN (SELECT label, list(x ORDER BY pos) AS w FROM (SELECT label, pos, sum(x) AS x "
    "FROM (SELECT label, generate_subscripts(e, 1) AS pos, unnest(list_transform(e, lambda x: "
    "x / sqrt(list_dot_product(e, e)))) AS x FROM s WHERE role = 'enroll') GROUP BY label, pos) GROUP BY label) d "
    "USING (label)",
    ("s",),
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", as_double_array("embedding").alias("vec")
    )


def enroll_and_probe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    split = splits.enroll_probe_split(vectors(spark, sf_dir), ["label"], ["id"], ENROLL)
    return (
        split.where(F.col("role") == "enroll").drop("role"),
        split.where(F.col("role") == "probe").drop("role"),
    )


def gallery(spark: SparkSession, sf_dir: str, method: str = "mean") -> DataFrame:
    """One stored template per label; the label is also its id."""
    enrolled, _ = enroll_and_probe(spark, sf_dir)
    fused = templates.create_templates(enrolled, method)
    return cut_lineage(fused.select(F.col("label").cast("bigint").alias("id"), "label", "vec"))


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``probe_id, true_identity, identity, score`` for every probe and template."""
    _, probes = enroll_and_probe(spark, sf_dir)
    scores = grid_scores(probes, gallery(spark, sf_dir))
    return scores.select(
        F.col("a_id").alias("probe_id"),
        F.col("a_label").alias("true_identity"),
        F.col("b_label").alias("identity"),
        "score",
    )


def _coordinates(fused: DataFrame) -> DataFrame:
    return fused.select("label", F.posexplode("vec").alias("pos", "x")).select(
        "label", (F.col("pos") + 1).cast("bigint").alias("pos"), rounded("x").alias("value")
    )


@query(
    "k06_enroll_probe_split",
    with_ctes("s", "SELECT vec_id, label, role FROM s"),
)
def enroll_probe(spark, sf_dir):
    df = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), "label")
    return splits.enroll_probe_split(df, ["label"], ["vec_id"], ENROLL)


@query(
    "e01_similarities",
    with_ctes(
        "u",
        f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, {r('list_dot_product(a.n, b.n)')} AS cosine, "
        f"{r('-list_distance(a.e, b.e)')} AS euclidean, "
        f"{r('-list_sum(list_transform(range(1, len(a.e) + 1), lambda i: abs(a.e[i] - b.e[i])))')} AS manhattan, "
        f"(SELECT {r('corr(x, y)')} FROM (SELECT unnest(a.e) AS x, unnest(b.e) AS y)) AS pearson "
        "FROM u a JOIN u b ON b.vec_id = a.vec_id + 1",
    ),
)
def similarities(spark, sf_dir):
    """Every vector against the next one under the four similarities."""
    base = vectors(spark, sf_dir)
    methods = ("cosine", "euclidean", "manhattan", "pearson")
    ready = base.select("id", *[prepared(F.col("vec"), m).alias(m) for m in methods])
    left = ready.select(F.col("id").alias("a_id"), *[F.col(m).alias(f"a_{m}") for m in methods])
    right = ready.select(F.col("id").alias("b_id"), *[F.col(m).alias(f"b_{m}") for m in methods])
    joined = left.join(right, F.col("b_id") == F.col("a_id") + 1)
    return joined.select(
        "a_id",
        "b_id",
        *[rounded(similarity(F.col(f"a_{m}"), F.col(f"b_{m}"), m)).alias(m) for m in methods],
    )


@query(
    "e02_score_table",
    with_ctes("sc", f"SELECT probe_id, true_identity, identity, {r('score')} AS score FROM sc"),
)
def scores(spark, sf_dir):
    return score_table(spark, sf_dir).withColumn("score", rounded("score"))


_FUSED = f"SELECT label, pos, {r('m')} AS value FROM "


@query("e03_mean_templates", with_ctes("tm", _FUSED + "tm"))
def mean(spark, sf_dir):
    return _coordinates(templates.create_templates(enroll_and_probe(spark, sf_dir)[0], "mean"))


@query(
    "e04_median_templates",
    with_ctes("en", _FUSED + "(SELECT label, pos, median(x) AS m FROM en GROUP BY label, pos)"),
)
def median(spark, sf_dir):
    return _coordinates(templates.create_templates(enroll_and_probe(spark, sf_dir)[0], "median"))


@query(
    "e05_trimmed_mean_templates",
    with_ctes(
        "v",
        _FUSED + "(SELECT label, pos, avg(x) AS m FROM (SELECT *, row_number() OVER (PARTITION BY label, pos "
        "ORDER BY x, vec_id) AS rn, count(*) OVER (PARTITION BY label, pos) AS n FROM (SELECT vec_id, label, "
        "unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v)) WHERE n < 5 OR "
        "(rn > floor(0.1::DOUBLE * n) AND rn <= n - floor(0.1::DOUBLE * n)) GROUP BY label, pos)",
    ),
)
def trimmed(spark, sf_dir):
    """Over all vectors of a label."""
    return _coordinates(templates.create_templates(vectors(spark, sf_dir), "trimmed_mean"))


@query(
    "e06_representative_templates",
    with_ctes(
        "ce",
        _FUSED + "(SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) "
        "AS pos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) AS rn, count(*) OVER "
        "(PARTITION BY label) AS n FROM ce) WHERE rn <= greatest(1, n // 2)) GROUP BY label, pos)",
    ),
)
def representative(spark, sf_dir):
    return _coordinates(templates.create_templates(enroll_and_probe(spark, sf_dir)[0], "representative"))


@query(
    "e07_soft_centrality_templates",
    with_ctes(
        "ce",
        _FUSED + "(SELECT label, pos, sum(w * x) / sum(w) AS m FROM (SELECT label, w, unnest(e) AS x, "
        "generate_subscripts(e, 1) AS pos FROM (SELECT *, exp((c - max(c) OVER (PARTITION BY label)) / 0.1::DOUBLE) "
        "AS w FROM ce)) GROUP BY label, pos)",
    ),
)
def soft_centrality(spark, sf_dir):
    return _coordinates(templates.create_templates(enroll_and_probe(spark, sf_dir)[0], "soft_centrality"))


@query(
    "e08_geometric_median_templates",
    with_ctes(
        "tv",
        f"SELECT label, pos, {r('m')} AS value FROM (SELECT label, unnest(c) AS m, "
        "generate_subscripts(c, 1) AS pos FROM (SELECT label, max_by(c, it) AS c FROM g GROUP BY label))",
    ).replace("WITH ", "WITH RECURSIVE ", 1).replace(
        ") SELECT label, pos, (round",
        "), g AS (SELECT identity AS label, 0 AS it, t AS c, false AS done FROM tv UNION ALL "
        "SELECT label, it + 1, nxt, list_distance(c, nxt) < 1e-4 FROM (SELECT label, it, c, "
        "list(m ORDER BY pos) AS nxt FROM (SELECT label, it, c, pos, sum(x / w) / sum(1 / w) AS m FROM "
        "(SELECT g.label, g.it, g.c, CASE WHEN list_distance(g.c, s.e) = 0 THEN 1e-5 ELSE list_distance(g.c, s.e) "
        "END AS w, unnest(s.e) AS x, generate_subscripts(s.e, 1) AS pos FROM g JOIN s ON s.label = g.label AND "
        "s.role = 'enroll' WHERE NOT g.done AND g.it < 20) GROUP BY label, it, c, pos) GROUP BY label, it, c)) "
        "SELECT label, pos, (round",
        1,
    ),
)
def geometric_median(spark, sf_dir):
    return _coordinates(templates.create_templates(enroll_and_probe(spark, sf_dir)[0], "geometric_median"))


@query(
    "e09_enrollment_budget",
    "SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn "
    "FROM embeddings) WHERE rn <= 7",
)
def budget(spark, sf_dir):
    kept = templates.create_templates(vectors(spark, sf_dir), "none", budget=7)
    return kept.select(F.col("id").alias("vec_id"), "label")


_FIRST = (
    "f1 AS (SELECT label, 1 AS template_no, vec_id, w FROM (SELECT *, row_number() OVER (PARTITION BY label "
    "ORDER BY c DESC, vec_id) AS rn FROM cc) WHERE rn = 1)"
)


def _next_template(step: int) -> str:
    chosen = " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(1, step))
    return (
        f"f{step} AS (SELECT label, {step} AS template_no, vec_id, w FROM (SELECT *, row_number() OVER "
        "(PARTITION BY label ORDER BY near, vec_id) AS rn FROM (SELECT a.label, a.vec_id, a.w, "
        f"max(list_dot_product(a.w, b.w)) AS near FROM cc a JOIN ({chosen}) b ON a.label = b.label "
        f"WHERE NOT EXISTS (SELECT 1 FROM ({chosen}) x WHERE x.vec_id = a.vec_id) "
        "GROUP BY a.label, a.vec_id, a.w)) WHERE rn = 1)"
    )


cte(
    "cu",
    "SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS w FROM s "
    "WHERE role = 'enroll'",
    ("s",),
)
cte(
    "cc",
    "SELECT cu.*, list_dot_product(cu.w, d.w) AS c FROM cu JOIN (SELECT label, list(x ORDER BY pos) AS w FROM "
    "(SELECT label, pos, sum(x) AS x FROM (SELECT label, generate_subscripts(w, 1) AS pos, unnest(w) AS x FROM cu) "
    "GROUP BY label, pos) GROUP BY label) d USING (label)",
    ("cu",),
)


@query(
    "e10_multi_templates",
    with_ctes("cc", "SELECT label, template_no, vec_id FROM (").replace(
        ") SELECT label, template_no",
        ", ".join(["), " + _FIRST, *[_next_template(k) for k in range(2, K_TEMPLATES + 1)]])
        + " SELECT label, template_no",
        1,
    )
    + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, K_TEMPLATES + 1))
    + ")",
)
def multi_templates(spark, sf_dir):
    chosen = templates.select_multi_templates(enroll_and_probe(spark, sf_dir)[0], K_TEMPLATES)
    return chosen.select("label", "template_no", F.col("id").alias("vec_id"))


@query(
    "e11_template_reduction",
    with_ctes(
        "s",
        f"SELECT p.vec_id AS probe_id, t.label AS identity, {r('max(list_dot_product(p.n, t.n))')} AS score "
        "FROM s p CROSS JOIN s t WHERE p.role = 'probe' AND t.role = 'enroll' GROUP BY ALL",
    ),
)
def template_reduction(spark, sf_dir):
    """Every enrolled vector is a template; an identity scores its best one."""
    enrolled, probes = enroll_and_probe(spark, sf_dir)
    single = probes.select("id", F.col("id").alias("group"), "vec")
    best = fusion.fused_scores(single, enrolled.select("id", F.col("label").alias("identity"), "vec"))
    return best.select(F.col("group").alias("probe_id"), "identity", rounded("score").alias("score"))


cte(
    "gr",
    f"SELECT * FROM (SELECT vec_id, label, vec_id % 2 AS session, (row_number() OVER (PARTITION BY label, "
    f"vec_id % 2 ORDER BY vec_id) - 1) // {K_GROUP} AS group_no, count(*) OVER (PARTITION BY label, vec_id % 2) AS n, "
    f"row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) AS rn FROM s WHERE role = 'probe') "
    f"WHERE rn <= n - n % {K_GROUP}",
    ("s",),
)


def grouped_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe vectors in groups of three per label and session."""
    _, probes = enroll_and_probe(spark, sf_dir)
    blocks = probes.select("id", "label", (F.col("id") % 2).alias("session"))
    return fusion.probe_groups(blocks, ["label", "session"], "id", K_GROUP)


@query("e12_probe_groups", with_ctes("gr", "SELECT vec_id, label, session, group_no FROM gr"))
def probe_groups(spark, sf_dir):
    return grouped_probes(spark, sf_dir).withColumnRenamed("id", "vec_id")


@query(
    "e12_group_diagnostics",
    with_ctes(
        "s",
        f"SELECT count(*) AS n_blocks, sum(n)::BIGINT AS n_rows, sum(n // {K_GROUP})::BIGINT AS n_groups, "
        f"sum(n % {K_GROUP})::BIGINT AS n_dropped, count_if(n < {K_GROUP})::BIGINT AS n_empty_blocks FROM "
        "(SELECT count(*) AS n FROM s WHERE role = 'probe' GROUP BY label, vec_id % 2)",
    ),
)
def group_diagnostics(spark, sf_dir):
    _, probes = enroll_and_probe(spark, sf_dir)
    blocks = probes.select("label", (F.col("id") % 2).alias("session"))
    return fusion.group_diagnostics(blocks, ["label", "session"], K_GROUP)


@query(
    "e13_score_fusion",
    with_ctes(
        "gr sc",
        f"SELECT label, session, group_no, identity, {r('avg(score)')} AS score FROM gr JOIN sc "
        "ON gr.vec_id = sc.probe_id GROUP BY ALL",
    ),
)
def score_fusion(spark, sf_dir):
    group = F.struct("label", "session", "group_no")
    members = grouped_probes(spark, sf_dir).join(vectors(spark, sf_dir).select("id", "vec"), "id")
    one = gallery(spark, sf_dir).select("id", F.col("label").alias("identity"), "vec")
    fused = fusion.fused_scores(members.select("id", F.to_json(group).alias("group"), "vec"), one)
    named = fused.withColumn("g", F.from_json("group", members.select(group.alias("g")).schema["g"].dataType))
    return named.select("g.*", "identity", rounded("score").alias("score"))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, probes = enroll_and_probe(spark, sf_dir)
    return identification.identification_ranks(probes, gallery(spark, sf_dir))


def gallery_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    return labels.agg(F.count(F.lit(1)).alias("n_identities"))


@query(
    "m01_identification_ranks",
    with_ctes("rk", "SELECT probe_id, true_identity, rnk AS rank FROM rk"),
)
def identification_ranks(spark, sf_dir):
    return ranks(spark, sf_dir).select(
        F.col("id").alias("probe_id"), F.col("label").alias("true_identity"), "rank"
    )


@query(
    "m01_multi_template_ranks",
    with_ctes(
        "s",
        "SELECT probe_id, count(*) AS rank FROM (SELECT probe_id, score >= max(CASE WHEN identity = true_identity "
        "THEN score END) OVER (PARTITION BY probe_id) AS hit FROM (SELECT p.vec_id AS probe_id, "
        "p.label AS true_identity, t.label AS identity, max(list_dot_product(p.n, t.n)) AS score FROM s p "
        "CROSS JOIN s t WHERE p.role = 'probe' AND t.role = 'enroll' GROUP BY ALL)) WHERE hit GROUP BY ALL",
    ),
)
def multi_template_ranks(spark, sf_dir):
    enrolled, probes = enroll_and_probe(spark, sf_dir)
    found = identification.identification_ranks(probes, enrolled, one_template=False)
    return found.select(F.col("id").alias("probe_id"), "rank")


@query(
    "m02_cmc_curve",
    with_ctes(
        "rk",
        f"SELECT g.rank, {r('count_if(rk.rnk <= g.rank) / count(*)')} AS rate FROM (SELECT unnest(range(1, "
        "(SELECT count(DISTINCT label) FROM embeddings) + 1)) AS rank) g CROSS JOIN rk GROUP BY g.rank",
    ),
)
def cmc_curve(spark, sf_dir):
    curve = identification.match_curve(ranks(spark, sf_dir), gallery_size(spark, sf_dir))
    return curve.withColumn("rate", rounded("rate"))


@query(
    "m03_headline_rates",
    with_ctes(
        "rk",
        f"SELECT count(*) AS n_probes, g.n AS n_identities, {r('avg((rnk <= 1)::INT)')} AS rank_1, CASE WHEN g.n > 5 "
        f"THEN {r('avg((rnk <= 5)::INT)')} END AS rank_5 FROM rk CROSS JOIN "
        "(SELECT count(DISTINCT label) AS n FROM embeddings) g GROUP BY g.n",
    ),
)
def headline_rates(spark, sf_dir):
    rates = identification.headline_rates(ranks(spark, sf_dir), gallery_size(spark, sf_dir))
    return rates.withColumn("rank_1", rounded("rank_1")).withColumn("rank_5", rounded("rank_5"))
