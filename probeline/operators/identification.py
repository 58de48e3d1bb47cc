"""1:N search: genuine scores, pessimistic ranks and the cumulative match curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from probeline.functions.columns import prepared, similarity
from probeline.functions.ordering import running_sum
from probeline.operators import scoring
from probeline.operators.scoring import grid_scores
from probeline.session import cut_lineage


_NOT_FINITE = "scores must be finite; a constant vector has no correlation, a zero one no cosine"


def genuine_scores(
    probes: DataFrame, templates: DataFrame, method: str = "cosine", by: Sequence[str] = ()
) -> DataFrame:
    """Each probe's best score with its own identity; probes whose identity is not enrolled raise.

    Inputs are prepared. Joining on the label is an equi join that AQE can split when one label is large.
    """
    own = templates.select(*by, "label", F.col("vec").alias("__t"))
    scored = probes.join(own, [*by, "label"], "left").withColumn(
        "s",
        F.when(F.col("__t").isNull(), F.raise_error(F.lit("probe identity is not enrolled")).cast("double"))
        .otherwise(similarity(F.col("vec"), F.col("__t"), method)),
    )
    finite = F.when(F.col("s").isNotNull() & (F.isnan("s") | (F.abs("s") == float("inf"))), F.raise_error(F.lit(_NOT_FINITE)).cast("double"))
    best = scored.groupBy(*by, "id").agg(F.max(finite.otherwise(F.col("s"))).alias("bar"))
    return probes.join(best, [*by, "id"])


def identification_ranks(
    probes: DataFrame,
    templates: DataFrame,
    method: str = "cosine",
    one_template: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Pessimistic rank: how many identities score at least the genuine score, the genuine one included.

    ``probes(id, label, vec)``, ``templates(id, label, vec)``. Scores are compared inside the grid cells;
    only counts leave them. With several templates per identity the templates of one identity share a cell.
    """
    ready = lambda df: df.withColumn("vec", prepared(F.col("vec"), method))
    # Stored once: both the bar and the grid must see the same doubles.
    by = list(by)
    gallery = cut_lineage(ready(templates).select(*by, "id", "label", "vec"))
    barred = cut_lineage(genuine_scores(ready(probes).select(*by, "id", "label", "vec"), gallery, method, by))
    if one_template:
        counts = grid_scores(barred, gallery, method, "count", is_prepared=True, by=by)
        ranks = counts.groupBy(*by, "id").agg(F.sum("n_at_least").alias("rank"))
    else:
        sizes = gallery.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.where(F.col("n") > scoring.WHOLE_ROWS).drop("n")
        if large.isEmpty():
            counts = grid_scores(barred, gallery, method, "count", is_prepared=True, by=by, whole=True)
        else:
            # identities too large for one cell are cut, and each cell tells once that one passed
            kept, cut = (gallery.join(large, [*by, "label"], how) for how in ("left_anti", "left_semi"))
            own = ["id", "label", "vec"]
            counts = grid_scores(barred, kept.select(*by, *own), method, "count", is_prepared=True, by=by, whole=True)
            hits = grid_scores(barred, cut.select(*by, *own), method, "hits", is_prepared=True, by=by).distinct()
            counts = counts.unionByName(hits.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("n_at_least")))
        ranks = counts.groupBy(*by, "id").agg(F.sum("n_at_least").alias("rank"))
    return barred.select(*by, "id", "label", "bar").join(ranks, [*by, "id"])


def ranks_from_scores(scores: DataFrame, keys: tuple[str, ...] = ("probe_id",)) -> DataFrame:
    """The same rank from a stored score table ``(keys…, identity, true_identity, score)``."""
    score = F.col("score")
    bad = score.isNotNull() & (F.isnan(score) | (F.abs(score) == float("inf")))
    scores = scores.withColumn("score", F.when(bad, F.raise_error(F.lit(_NOT_FINITE)).cast("double")).otherwise(score))
    own = scores.where(F.col("identity") == F.col("true_identity")).select(*keys, F.col("score").alias("bar"))
    return scores.join(own, list(keys)).groupBy(*keys, "true_identity").agg(
        F.count_if(F.col("score") >= F.col("bar")).alias("rank")
    )


def match_curve(ranks: DataFrame, gallery_size: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of probes ranked at most r, for r from 1 to the gallery size.

    ``gallery_size`` has one row (per ``by``) with column ``n_identities``. Only rank counts are windowed,
    at most one row per rank.
    """
    by = list(by)
    counts = ranks.groupBy(*by, F.col("rank").cast("bigint").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    size = F.col("n_identities").cast("bigint")
    blocks = F.when(size > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / 4096)))
    first = F.col("__block") * 4096
    # the rank axis is laid out block by block, not as one array in one row
    grid = gallery_size.withColumn("__block", F.explode(blocks)).repartition("__block")
    grid = grid.withColumn("rank", F.explode(F.sequence(first + 1, F.least(first + 4096, size)))).drop("__block")
    filled = grid.join(counts, [*by, "rank"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = running_sum(filled, by, ["rank"], F.floor(F.col("rank") / 4096), "n", "found")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("n_probes"))
    joined = found.join(totals, by) if by else found.crossJoin(F.broadcast(totals))  # one row
    return joined.select(*by, "rank", (F.col("found") / F.col("n_probes")).alias("rate"))


def headline_rates(ranks: DataFrame, gallery_size: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank-1 and Rank-5 rates; Rank-5 is NULL unless more than five identities are enrolled."""
    by = list(by)

    def rate(k: int) -> Column:
        return F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))

    rates = ranks.groupBy(*by).agg(rate(1).alias("rank_1"), rate(5).alias("__r5"), F.count(F.lit(1)).alias("n_probes"))
    joined = rates.join(gallery_size, by) if by else rates.crossJoin(F.broadcast(gallery_size))  # one row each
    return joined.select(
        *by,
        "n_probes",
        F.col("n_identities").cast("bigint").alias("n_identities"),
        "rank_1",
        F.when(F.col("n_identities") > 5, F.col("__r5")).alias("rank_5"),
    )
