"""1:1 error curves and the numbers read from them.

Decisions are first reduced to one row per distinct score with ``n_genuine`` and ``n_impostor``. A curve
row also knows its own counts, so the point before it needs no lag window and every reading of the
curve is a plain aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from probeline.functions.ordering import running_sum, running_totals, with_value_bucket
from probeline.session import cut_lineage

#: Operating points reported by default; the headline point is always among them.
HEADLINE_FAR = 0.001
DEFAULT_FARS = (0.1, 0.01, 0.001, 0.0001)
FAR_TOLERANCE = 32 * 2.220446049250313e-16


def histogram(decisions: DataFrame) -> DataFrame:
    """Distinct scores of a decision table ``(score, is_genuine)``."""
    return decisions.groupBy("score").agg(
        F.count_if(F.col("is_genuine") == 1).alias("n_genuine"),
        F.count_if(F.col("is_genuine") == 0).alias("n_impostor"),
    )


def error_curve(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct threshold, highest first: ``far, tar, frr`` and the same before the row.

    With ``by`` every run gets its own curve in the same job.
    """
    by = list(by)
    if by:
        cut = with_value_bucket(cut_lineage(hist), by, "score").withColumn("__down", -F.col("__vb"))
        placed = running_sum(cut, by, [F.desc("score")], "__down", "n_genuine", "cum_g")
        placed = running_sum(placed, by, [F.desc("score")], "__down", "n_impostor", "cum_i")
    else:
        placed = running_totals(hist, F.col("score"), {"n_genuine": "cum_g", "n_impostor": "cum_i"}, descending=True)
    totals = placed.groupBy(*by).agg(F.sum("n_genuine").alias("g"), F.sum("n_impostor").alias("i"))
    joined = placed.join(totals, by) if by else placed.crossJoin(F.broadcast(totals))  # one row
    return with_rates(joined, by)


def with_rates(placed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Curve columns from cumulative counts ``cum_g, cum_i``, own counts and class totals ``g, i``."""

    def rates(own: bool) -> tuple[Column, Column]:
        genuine = F.col("cum_g") if own else F.col("cum_g") - F.col("n_genuine")
        impostor = F.col("cum_i") if own else F.col("cum_i") - F.col("n_impostor")
        # a class without decisions has no rate: NULL
        return F.try_divide(impostor, F.col("i")), F.try_divide(genuine, F.col("g"))

    far, tar = rates(True)
    far_before, tar_before = rates(False)
    return placed.select(
        *by,
        F.col("score").alias("threshold"),
        far.alias("far"),
        tar.alias("tar"),
        (1 - tar).alias("frr"),
        far_before.alias("far_before"),
        tar_before.alias("tar_before"),
        (1 - tar_before).alias("frr_before"),
        "n_genuine",
        "n_impostor",
        F.col("g").alias("genuine"),
        F.col("i").alias("impostor"),
    )


def roc_points(curve: DataFrame) -> DataFrame:
    """All ROC points with the origin in front (no threshold)."""
    origin = curve.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("far"), F.lit(0.0).alias("tar"), F.lit(1.0).alias("frr")
    )
    return curve.select("threshold", "far", "tar", "frr").unionByName(origin)


def det_points(curve: DataFrame) -> DataFrame:
    return curve.select("threshold", "far", "frr")


def curve_summary(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Equal error rate and area in one pass over the curve.

    EER: the first point with FAR = FRR, else linear interpolation where their difference changes sign.
    """
    gap, before = F.col("far") - F.col("frr"), F.col("far_before") - F.col("frr_before")
    order = -F.col("threshold")
    share = F.try_divide(-before, gap - before)
    crossing = 0.5 * (
        F.col("far_before") + share * (F.col("far") - F.col("far_before"))
        + F.col("frr_before") + share * (F.col("frr") - F.col("frr_before"))
    )
    exact = F.min(F.when(gap == 0, F.struct(order.alias("o"), F.col("far").alias("v"))))
    crossed = F.min(F.when(gap * before < 0, F.struct(order.alias("o"), crossing.alias("v"))))
    area = F.sum((F.col("far") - F.col("far_before")) * (F.col("tar") + F.col("tar_before")) / 2)
    return curve.groupBy(*by).agg(exact.alias("x"), crossed.alias("c"), area.alias("auc")).select(
        *by, F.coalesce("x.v", "c.v").alias("eer"), "auc"
    )


def operating_points(
    curve: DataFrame, targets: Iterable[float] = DEFAULT_FARS, by: Sequence[str] = ()
) -> DataFrame:
    """Highest observed TAR with FAR at most the target; never interpolated.

    ``tar_reported`` is NULL where the impostor count cannot resolve the target.
    """
    fars = sorted({*targets, HEADLINE_FAR})
    if not all(0 < t < 1 for t in fars):
        raise ValueError("targets must lie strictly between 0 and 1")
    rows = curve.withColumn("target_far", F.explode(F.array(*[F.lit(t) for t in fars])))
    key = F.struct(
        F.col("tar").alias("tar"), (-F.col("far")).alias("f"), F.col("threshold").alias("threshold"),
    )
    fits = F.col("far") <= F.col("target_far") + FAR_TOLERANCE
    best = rows.groupBy(*by, "target_far").agg(
        F.max(F.when(fits & (F.col("tar") > 0), key)).alias("b"), F.first("impostor").alias("n")
    )
    tar = F.coalesce("b.tar", F.lit(0.0))
    return best.select(
        *by,
        "target_far",
        F.coalesce(-F.col("b.f"), F.lit(0.0)).alias("observed_far"),
        tar.alias("tar"),
        F.col("b.threshold").alias("threshold"),
        (1 / F.col("n") <= F.col("target_far")).alias("resolvable"),
        F.when(1 / F.col("n") <= F.col("target_far"), tar).alias("tar_reported"),
    )


def d_prime(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Separation of the two score distributions, with population variances."""
    g, i, s = F.col("n_genuine"), F.col("n_impostor"), F.col("score")
    by = list(by)
    means = hist.groupBy(*by).agg(F.try_divide(F.sum(g * s), F.sum(g)).alias("mg"), F.try_divide(F.sum(i * s), F.sum(i)).alias("mi"))
    spread = hist.join(means, by) if by else hist.crossJoin(F.broadcast(means))  # one row
    squares = lambda n, m: F.try_divide(F.sum(n * (s - F.col(m)) * (s - F.col(m))), F.sum(n))
    out = spread.groupBy(*by).agg(
        F.first("mg").alias("mg"), F.first("mi").alias("mi"), squares(g, "mg").alias("vg"), squares(i, "mi").alias("vi")
    )
    gap = F.abs(F.col("mg") - F.col("mi"))
    return out.select(
        *by,
        F.col("mg").alias("genuine_mean"),
        F.col("mi").alias("impostor_mean"),
        (gap / F.sqrt(0.5 * (F.col("vg") + F.col("vi")) + 1e-10)).alias("d_prime"),
    )


def pair_summary(hist: DataFrame, target_far: float = HEADLINE_FAR) -> DataFrame:
    counts = hist.agg(
        F.sum(F.col("n_genuine") + F.col("n_impostor")).alias("n_total"),
        F.sum("n_genuine").alias("n_genuine"),
        F.sum("n_impostor").alias("n_impostor"),
    )
    smallest = F.when(F.col("n_impostor") > 0, 1 / F.col("n_impostor"))
    return counts.select(
        "*", smallest.alias("smallest_far"), F.coalesce(smallest <= target_far, F.lit(False)).alias("resolvable")
    )


def calibration_threshold(curve: DataFrame) -> DataFrame:
    """The highest threshold whose FAR and FRR are closest."""
    key = F.struct(F.abs(F.col("frr") - F.col("far")).alias("gap"), (-F.col("threshold")).alias("o"))
    return curve.agg(F.min_by("threshold", key).alias("threshold"))


def apply_threshold(hist: DataFrame, threshold: DataFrame) -> DataFrame:
    """Accuracy, FAR and FRR of decisions at a frozen threshold; a rate without decisions is 0."""
    joined = hist.crossJoin(F.broadcast(threshold))  # one row
    accept = F.col("score") >= F.col("threshold")
    g, i = F.sum("n_genuine"), F.sum("n_impostor")
    false_accepts = F.sum(F.when(accept, F.col("n_impostor")).otherwise(0))
    false_rejects = F.sum(F.when(accept, 0).otherwise(F.col("n_genuine")))
    return joined.agg(
        F.first("threshold").alias("threshold"),
        ((g + i - false_accepts - false_rejects) / (g + i)).alias("accuracy"),
        F.when(i > 0, false_accepts / i).otherwise(0.0).alias("far"),
        F.when(g > 0, false_rejects / g).otherwise(0.0).alias("frr"),
    )


def decision_problems(decisions: DataFrame) -> DataFrame:
    """Counts of unusable decisions; a valid table has zeros and both classes."""
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs(F.col("score")) != float("inf"))
    return decisions.agg(
        F.count_if(~finite).alias("n_not_finite"),
        F.count_if(~F.coalesce(F.col("is_genuine").isin(0, 1), F.lit(False))).alias("n_not_binary"),
        F.count_if(F.col("is_genuine") == 1).alias("n_genuine"),
        F.count_if(F.col("is_genuine") == 0).alias("n_impostor"),
    )


def comparison_problems(cells: DataFrame) -> DataFrame:
    """The same from ``problems`` grid output; classes made from labels are always binary."""
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)
    return cells.agg(
        total("n_not_finite"), F.lit(0).cast("bigint").alias("n_not_binary"), total("n_genuine"), total("n_impostor")
    )


def predicted_identity(scores: DataFrame) -> DataFrame:
    """Best-scoring identity per probe; ties go to the smallest identity."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("identity").alias("identity")))
    return scores.groupBy("probe_id", "true_identity").agg(best.alias("b")).select(
        "probe_id", "true_identity", F.col("b.identity").alias("predicted")
    )


def nearest_identity(best: DataFrame, probes: DataFrame) -> DataFrame:
    """The same from ``best`` grid output, which holds one row per probe and piece of the gallery."""
    top = F.min(F.struct((-F.col("score")).alias("s"), F.col("label").alias("identity")))
    nearest = best.groupBy("id").agg(top.alias("b")).select("id", F.col("b.identity").alias("predicted"))
    own = probes.select("id", F.col("label").alias("true_identity"))
    return own.join(nearest, "id").withColumnRenamed("id", "probe_id")


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts per true and predicted identity and their share of the true identity."""
    cells = predictions.groupBy("true_identity", "predicted").agg(F.count(F.lit(1)).alias("n"))
    totals = predictions.groupBy("true_identity").agg(F.count(F.lit(1)).alias("__n"))
    return cells.join(totals, "true_identity").select(
        "true_identity", "predicted", "n", (F.col("n") / F.col("__n")).alias("share")
    )
