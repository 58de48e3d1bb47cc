"""Whole studies from role-tagged vectors to metrics, all runs (seeds) in the same jobs.

Input rows are ``(seed, id, label, vec, role)`` with roles ``enroll`` and ``probe``. Labels are made
unique per run, so fusion needs no extra key; scoring compares rows of the same run only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from probeline.operators import identification, templates, verification
from probeline.operators.scoring import score_histogram
from probeline.session import cut_lineage

BY = ["seed"]


def _sides(rows: DataFrame, fusion: str) -> tuple[DataFrame, DataFrame]:
    tagged = rows.withColumn("label", F.concat_ws(":", F.col("seed").cast("string"), F.col("label").cast("string")))
    stored = cut_lineage(tagged)
    probes = stored.where(F.col("role") == "probe").select("seed", "id", "label", "vec")
    enrolled = stored.where(F.col("role") == "enroll").select("id", "label", "vec")
    fused = templates.create_templates(enrolled, fusion)
    run = F.substring_index("label", ":", 1).cast(rows.schema["seed"].dataType)
    gallery = cut_lineage(fused.select(run.alias("seed"), F.col("label").alias("id"), "label", "vec"))
    return probes, gallery


def identification_study(rows: DataFrame, fusion: str = "mean", method: str = "cosine") -> DataFrame:
    """Per run: probes, identities, Rank-1 and Rank-5."""
    probes, gallery = _sides(rows, fusion)
    sizes = gallery.groupBy(*BY).agg(F.count_distinct("label").alias("n_identities"))
    ranks = identification.identification_ranks(probes, gallery, method, by=BY)
    return identification.headline_rates(ranks, sizes, tuple(BY))


def verification_study(rows: DataFrame, fusion: str = "mean", method: str = "cosine") -> DataFrame:
    """Per run: counts, equal error rate, area, d' and TAR at the headline FAR over all comparisons."""
    probes, gallery = _sides(rows, fusion)
    hist = cut_lineage(score_histogram(probes, gallery, method, by=BY))
    curve = cut_lineage(verification.error_curve(hist, BY))
    counts = hist.groupBy(*BY).agg(F.sum("n_genuine").alias("n_genuine"), F.sum("n_impostor").alias("n_impostor"))
    headline = verification.operating_points(curve, [verification.HEADLINE_FAR], BY).select(
        *BY, F.col("tar_reported").alias("tar_at_far")
    )
    return (
        counts.join(verification.curve_summary(curve, BY), BY)
        .join(verification.d_prime(hist, BY).select(*BY, "d_prime"), BY)
        .join(headline, BY)
    )
