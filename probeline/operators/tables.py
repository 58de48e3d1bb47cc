"""Result tables from run records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def result_table(catalogue: DataFrame, results: DataFrame, identity: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per catalogue entry with its metrics in columns; entries without exactly one result per
    metric get NULL and ``missing`` true."""
    identity = list(identity)
    single = results.groupBy(*identity, "metric").agg(F.count(F.lit(1)).alias("__n"), F.first("value").alias("value"))
    wide = single.where(F.col("__n") == 1).groupBy(*identity).pivot("metric", list(metrics)).agg(F.first("value"))
    joined = catalogue.join(wide, identity, "left")
    absent = F.lit(False)
    for metric in metrics:
        absent = absent | F.col(metric).isNull()
    return joined.withColumn("missing", absent)


def missing_results(catalogue: DataFrame, results: DataFrame, identity: Sequence[str]) -> DataFrame:
    return catalogue.join(results.select(*identity), list(identity), "left_anti")


def coverage(catalogue: DataFrame, results: DataFrame, identity: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Expected, found and surplus entries per group with subtotals and a grand total.

    ``by`` columns are NULL in total rows.
    """
    identity = list(identity)
    told = catalogue.select(*identity).distinct().withColumn("__c", F.lit(1))
    have = results.select(*identity).distinct().withColumn("__r", F.lit(1))
    both = told.join(have, identity, "full_outer")
    found = F.col("__c").isNotNull() & F.col("__r").isNotNull()
    return both.rollup(*by).agg(
        F.count("__c").alias("n_expected"),
        F.count_if(found).alias("n_found"),
        F.count_if(F.col("__c").isNull()).alias("n_surplus"),
        F.count_if(F.col("__r").isNull()).alias("n_missing"),
    )


def complete_series(runs: DataFrame, series: Sequence[str], expected: int) -> DataFrame:
    """Series with a finite value for every one of the expected seeds, with their mean."""
    value = F.col("value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    facts = runs.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.coalesce(finite, F.lit(False))).alias("__ok"),
        F.count_distinct("seed").alias("__seeds"), F.avg("value").alias("mean"),
    )
    whole = (F.col("__ok") == F.col("n_runs")) & (F.col("__seeds") == expected)
    return facts.where(whole).select(*series, "n_runs", "mean")
