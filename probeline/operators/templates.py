"""Fusion of enrollment vectors into templates, one group of aggregates per method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from probeline.functions.columns import array_sum, dot, norm, scaled
from probeline.functions.ordering import exact_percentiles, numbered, with_value_bucket
from probeline.session import cut_lineage


def _long(df: DataFrame, *kept: str) -> DataFrame:
    return df.select("label", *kept, F.posexplode("vec").alias("pos", "x"))


def _as_array(coordinates: DataFrame, value: str) -> DataFrame:
    """One row per coordinate back to one vector per label: ``label, vec``."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", value)))
    return coordinates.groupBy("label").agg(F.transform(pairs, lambda p: p[value]).alias("vec"))


def first_per_key(df: DataFrame, keys: list[str], order: list, n: int, name: str | None = None) -> DataFrame:
    """First ``n`` rows of each key, numbered from 1 in ``name`` if given.

    The rank filter is pushed below the shuffle as a group limit.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn("__rn", position).where(F.col("__rn") <= n)
    return kept.withColumnRenamed("__rn", name) if name else kept.drop("__rn")


def mean_templates(df: DataFrame) -> DataFrame:
    return _as_array(_long(df).groupBy("label", "pos").agg(F.avg("x").alias("m")), "m")


def median_templates(df: DataFrame) -> DataFrame:
    medians = exact_percentiles(_long(df), ["label", "pos"], "x", {"m": 0.5})
    return _as_array(medians, "m")


def trimmed_mean_templates(df: DataFrame, share: float = 0.1, smallest: int = 5) -> DataFrame:
    """Mean without the ``share`` lowest and highest values per coordinate; plain mean for few rows."""
    keys = ["label", "pos"]
    cut = with_value_bucket(_long(df, "id"), keys, "x", 64)
    ranked = numbered(cut, keys, ["x", "id"], "__vb", "__rn", total="__n")
    trim = F.when(F.col("__n") < smallest, 0).otherwise(F.floor(F.col("__n") * share))
    kept = ranked.where((F.col("__rn") > trim) & (F.col("__rn") <= F.col("__n") - trim))
    return _as_array(kept.groupBy(*keys).agg(F.avg("x").alias("m")), "m")


def with_centrality(df: DataFrame) -> DataFrame:
    """Add ``centrality``: the summed cosine to the label's other rows.

    Summing cosines is a dot product with the label's summed unit vector, so no pair is formed.
    """
    # A zero vector stays zero, as it would in a row normaliser.
    length = norm(F.col("vec"))
    unit = df.withColumn("unit", scaled(F.col("vec"), F.when(length > 0, length).otherwise(1.0)))
    totals = unit.select("label", F.posexplode("unit").alias("pos", "x"))
    sums = _as_array(totals.groupBy("label", "pos").agg(F.sum("x").alias("s")), "s")
    joined = unit.join(sums.withColumnRenamed("vec", "direction"), "label")
    return joined.withColumn("centrality", dot(F.col("unit"), F.col("direction")) - 1.0)


def representative_templates(df: DataFrame) -> DataFrame:
    """Mean of the most central half; ties by id."""
    central = cut_lineage(with_centrality(df).drop("unit", "direction"))
    cut = with_value_bucket(central, ["label"], "centrality", 256)
    ranked = numbered(
        cut, ["label"], [F.desc("centrality"), F.asc("id")], -F.col("__vb"), "__rn", total="__n"
    )
    return mean_templates(ranked.where(F.col("__rn") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 2))))


def soft_centrality_templates(df: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Mean weighted by the softmax of centrality."""
    central = cut_lineage(with_centrality(df).drop("unit", "direction"))
    tops = central.groupBy("label").agg(F.max("centrality").alias("__top"))
    weighted = central.join(tops, "label").withColumn(
        "w", F.exp((F.col("centrality") - F.col("__top")) / temperature)
    )
    coordinates = _long(weighted, "w").groupBy("label", "pos")
    return _as_array(coordinates.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m")), "m")


def geometric_median_templates(
    df: DataFrame, rounds: int = 20, tolerance: float = 1e-4, floor: float = 1e-5, cut_every: int = 4
) -> DataFrame:
    """Weiszfeld iteration for all labels at once; a label stops moving once it has converged.

    Labels are dropped from later rounds when done, and the small state table is checkpointed so the
    plan stays short.
    """
    df = cut_lineage(df.select("id", "label", "vec"))  # read in every round
    state = cut_lineage(mean_templates(df).select("label", "vec", F.lit(False).alias("done")))
    for step in range(1, rounds + 1):
        active = state.where(~F.col("done")).select("label", F.col("vec").alias("centre"))
        gaps = F.zip_with("vec", "centre", lambda x, y: (x - y) * (x - y))
        distance = F.sqrt(array_sum(gaps))
        weighted = df.join(active, "label").withColumn(
            "w", F.lit(1.0) / F.when(distance == 0, floor).otherwise(distance)
        )
        moved = _long(weighted, "w").groupBy("label", "pos")
        moved = _as_array(moved.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m")), "m")
        step_size = F.sqrt(array_sum(F.zip_with("vec", "next", lambda x, y: (x - y) * (x - y))))
        state = state.join(moved.withColumnRenamed("vec", "next"), "label", "left").select(
            "label",
            F.coalesce("next", "vec").alias("vec"),
            (F.col("done") | F.coalesce(step_size < tolerance, F.lit(False))).alias("done"),
        )
        if step % cut_every == 0 or step == rounds:
            state = cut_lineage(state)
            if state.where(~F.col("done")).isEmpty():
                break
    return state.select("label", "vec")


FUSIONS = {
    "mean": mean_templates,
    "median": median_templates,
    "trimmed_mean": trimmed_mean_templates,
    "representative": representative_templates,
    "soft_centrality": soft_centrality_templates,
    "geometric_median": geometric_median_templates,
}


def create_templates(
    df: DataFrame, method: str = "mean", budget: int | None = None, order: tuple[str, ...] = ("id",)
) -> DataFrame:
    """Templates ``label, vec`` (with ``id`` for method ``none``) from at most ``budget`` rows per label."""
    chosen = df if budget is None else first_per_key(df, ["label"], list(order), budget)
    if method == "none":
        return chosen.select("id", "label", "vec")
    if method not in FUSIONS:
        raise ValueError(f"unknown fusion {method!r}, expected 'none' or one of {sorted(FUSIONS)}")
    return FUSIONS[method](chosen)


def select_multi_templates(
    df: DataFrame, k: int, order: str = "id", budget: int | None = None, smallest_norm: float = 1e-12
) -> DataFrame:
    """Farthest-first choice of ``k`` rows per label under cosine: ``label, template_no, id, vec``.

    The first is closest to the label's summed direction; each further one is the row whose largest
    similarity to the chosen rows is smallest. ``order`` settles ties. Labels with fewer than ``k`` rows
    and vectors that are not finite or have no length raise an error.
    """
    pool = df if budget is None else first_per_key(df, ["label"], [order], budget)
    length = norm(F.col("vec"))
    finite = F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = finite & (length > smallest_norm)
    checked = pool.withColumn(
        "vec", F.when(usable, F.col("vec")).otherwise(F.raise_error(F.lit("vector without direction")))
    )
    central = with_centrality(checked).select("id", order, "label", "vec", "unit", "centrality") if order != "id" \
        else with_centrality(checked).select("id", "label", "vec", "unit", "centrality")
    sizes = pool.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    sized = central.join(sizes, "label").where(
        F.when(F.col("__n") >= k, True).otherwise(F.raise_error(F.lit("label has fewer rows than templates")))
    )
    candidates = cut_lineage(sized.withColumn("closest", F.lit(None).cast("double")).drop("__n"))

    def best(rows: DataFrame, key: Column, step: int) -> DataFrame:
        # min over a struct combines map-side: one row per label and task is shuffled
        picked = F.min(F.struct(key.alias("k"), F.col(order).alias("o"), F.col("id").alias("id"), "vec", "unit"))
        return rows.groupBy("label").agg(picked.alias("p")).select(
            "label", F.lit(step).cast("int").alias("template_no"), F.col("p.id").alias("id"), "p.vec", "p.unit"
        )

    latest = best(candidates, -F.col("centrality"), 1)
    chosen = latest
    for step in range(2, k + 1):
        last = latest.select("label", F.col("id").alias("__id"), F.col("unit").alias("__unit"))
        seen = candidates.join(last, "label").where(F.col("id") != F.col("__id"))
        seen = seen.withColumn(
            "closest", F.greatest(F.coalesce("closest", F.lit(-2.0)), dot(F.col("unit"), F.col("__unit")))
        )
        candidates = cut_lineage(seen.drop("__id", "__unit"))
        latest = best(candidates, F.col("closest"), step)
        chosen = chosen.unionByName(latest)
    return chosen.select("label", "template_no", "id", "vec")
