"""Probe groups inside one source block, and scores fused over a group or over templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from probeline.functions.columns import prepared
from probeline.functions.ordering import numbered, with_value_bucket
from probeline.operators import scoring
from probeline.operators.scoring import grid_scores
from probeline.session import cut_lineage


def source_order(df: DataFrame, keys: Sequence[str], row_id: str = "obs_id") -> DataFrame:
    """Add ``source_no``, the row's place in its group by true source order.

    A group whose rows all have an acquisition time (a date or a date and time) is ordered by it, any other group by acquisition
    order; inside a recording by segment and then by peak position, or by ordinal if any peak is unknown.
    """
    keys = list(keys)
    facts = df.groupBy(*keys).agg(
        F.bool_and(F.col("acquisition_time").isNotNull()).alias("__dated"),
        F.bool_and(F.col("rpeak_index") >= 0).alias("__peaks"),
    )
    moment = F.expr(
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(acquisition_time AS timestamp_ntz))"
    )
    joined = (
        df.join(facts, keys)
        .withColumn("__primary", F.when(F.col("__dated"), moment).otherwise(F.col("acquisition_order")))
        .withColumn("__within", F.when(F.col("__peaks"), F.col("rpeak_index")).otherwise(F.col("beat_ordinal")))
    )
    order = [
        "__primary",
        "acquisition_order",
        "record_id",
        "source_segment_order",
        "source_segment_id",
        "__within",
        row_id,
    ]
    cut = with_value_bucket(joined, keys, "__primary", 256)
    out = numbered(cut, keys, order, "__vb", "source_no")
    return out.drop("__dated", "__peaks", "__primary", "__within", "__vb")


def probe_groups(df: DataFrame, block: Sequence[str], order: str, k: int) -> DataFrame:
    """Groups of exactly ``k`` consecutive rows per block; an incomplete last group is dropped.

    Adds ``group_no`` (from 0 in the block).
    """
    block = list(block)
    cut = with_value_bucket(df, block, order, 256)
    placed = numbered(cut, block, [order], "__vb", "__rn", total="__n").drop("__vb")
    whole = F.col("__n") - F.col("__n") % k
    return (
        placed.where(F.col("__rn") <= whole)
        .withColumn("group_no", F.floor((F.col("__rn") - 1) / k).cast("bigint"))
        .drop("__rn", "__n")
    )


def group_diagnostics(df: DataFrame, block: Sequence[str], k: int) -> DataFrame:
    """How many rows form groups and how many are left over."""
    sizes = df.groupBy(*block).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum("n").alias("n_rows"),
        F.sum(F.floor(F.col("n") / k)).cast("bigint").alias("n_groups"),
        F.sum(F.col("n") % k).cast("bigint").alias("n_dropped"),
        F.count_if(F.col("n") < k).alias("n_empty_blocks"),
    )


def fused_scores(members: DataFrame, templates: DataFrame, method: str = "cosine") -> DataFrame:
    """``group, identity, score`` for every probe group and identity: the mean over the group's members per template,
    then the identity's best template.

    ``members(id, group, vec)``, ``templates(id, identity, vec)``; a template's id is unique in its identity. Means and best ones are
    taken inside grid cells, which hold whole groups and identities; no pair leaves them. What is larger than
    ``scoring.WHOLE_ROWS`` is cut, and cells give sums per group and template that are joined afterwards.
    """
    ready = lambda df, label: cut_lineage(
        df.select("id", F.col(label).alias("label"), prepared(F.col("vec"), method).alias("vec"))
    )
    left, right = ready(members, "group"), ready(templates, "identity")
    sizes = lambda df: df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    large = [cut_lineage(sizes(df).where(F.col("n") > scoring.WHOLE_ROWS).select("label")) for df in (left, right)]
    cells = lambda a, b, output: grid_scores(a, b, method, output, is_prepared=True, whole=output == "fused")
    if all(df.isEmpty() for df in large):
        return cells(left, right, "fused")
    small_left, large_left = (left.join(large[0], "label", how).select("id", "label", "vec") for how in ("left_anti", "left_semi"))
    small_right, large_right = (right.join(large[1], "label", how).select("id", "label", "vec") for how in ("left_anti", "left_semi"))
    partial = cells(large_left, right, "partial").unionByName(cells(small_left, large_right, "partial"))
    means = partial.groupBy("group", "identity", "template").agg((F.sum("total") / F.sum("n")).alias("score"))
    best = means.groupBy("group", "identity").agg(F.max("score").alias("score"))
    return cells(small_left, small_right, "fused").unionByName(best)


def fuse_scores(scores: DataFrame, groups: DataFrame, member: str, group: Sequence[str]) -> DataFrame:
    """Mean score of a group's members per identity. ``scores(member, identity, score)``."""
    joined = scores.join(groups.select(member, *group), member)
    return joined.groupBy(*group, "identity").agg(F.avg("score").alias("score"))


def reduce_templates(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best template score per identity: combines map-side before the shuffle."""
    return scores.groupBy(*keys, "identity").agg(F.max("score").alias("score"))


def missing_identities(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """Enrolled identities without any score."""
    return expected.join(scores.select("identity").distinct(), "identity", "left_anti")
