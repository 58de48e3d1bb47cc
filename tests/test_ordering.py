"""Bucketed ordering against plain windows, with one key holding a third of all rows."""

import random
import statistics

import pytest
from pyspark.sql import Window, functions as F

from probeline.functions import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    source = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 11}", i, round(source.gauss(0, 5), 1)) for i in range(1500)]
    return spark.createDataFrame(rows, "key string, id long, x double").cache()


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_numbered(skewed):
    w = Window.partitionBy("key").orderBy("x", "id")
    cut = ordering.with_value_bucket(skewed, ["key"], "x", 16)
    got = ordering.numbered(cut, ["key"], ["x", "id"], F.col("__vb"), "n", total="all")
    total = F.count(F.lit(1)).over(Window.partitionBy("key"))
    same(got.select("id", "n", "all"), skewed.select("id", F.row_number().over(w), total))


def test_numbered_without_keys(skewed):
    got = ordering.numbered(skewed, [], ["x", "id"], F.floor("x"), "n")
    want = skewed.select("id", F.row_number().over(Window.orderBy("x", "id")))
    same(got.select("id", "n"), want)


def test_running_sum_and_prior_max(skewed):
    w = Window.partitionBy("key").orderBy("x", "id")
    got = ordering.running_sum(skewed, ["key"], ["x", "id"], F.floor("x"), "id", "s")
    same(got.select("id", "s"), skewed.select("id", F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    top = ordering.prior_max(skewed, ["key"], ["x", "id"], F.floor("x"), {"m": "id"})
    rows = {r["id"]: r["m"] for r in top.select("id", "m").collect()}
    want = skewed.select("id", F.max("id").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m")).collect()
    assert rows == {r["id"]: r["m"] for r in want}


def test_running_totals(skewed):
    counts = skewed.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    got = ordering.running_totals(counts, F.col("x"), {"c": "upto"}, descending=True)
    w = Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    same(got.select("x", "upto"), counts.select("x", F.sum("c").over(w)))


def test_exact_percentiles(skewed):
    got = ordering.exact_percentiles(skewed, ["key"], "x", {"low": 0.05, "mid": 0.5}, buckets=8)
    want = {
        r["key"]: (r["a"], r["b"])
        for r in skewed.groupBy("key").agg(F.percentile("x", 0.05).alias("a"), F.percentile("x", 0.5).alias("b")).collect()
    }
    for row in got.collect():
        assert (row["low"], row["mid"]) == pytest.approx(want[row["key"]])


def test_percentile_of_equal_values(spark):
    df = spark.createDataFrame([("a", 2.0)] * 5 + [("b", None), ("b", 1.0), ("b", 4.0)], "key string, x double")
    got = {r["key"]: r["m"] for r in ordering.exact_percentiles(df, ["key"], "x", {"m": 0.5}).collect()}
    assert got == {"a": 2.0, "b": statistics.median([1.0, 4.0])}


def test_interval_lookup(spark):
    spans = spark.createDataFrame([("a", 0, 700), ("b", 700, 701), ("c", 701, 701), ("d", 701, 1000)], "n string, lo long, hi long")
    points = spark.range(1000).withColumnRenamed("id", "p")
    got = ordering.interval_lookup(points, "p", spans, "lo", "hi").groupBy("n").count()
    assert {r["n"]: r["count"] for r in got.collect()} == {"a": 700, "b": 1, "d": 299}


def test_interval_lookup_of_many_narrow_intervals(spark):
    """100,000 intervals at the low end, one that holds nearly the whole range, a gap, and one point drawn very often."""
    narrow = spark.range(100_000).selectExpr("CAST(id AS string) AS n", "2 * id AS lo", "2 * id + 2 AS hi")
    wide = spark.createDataFrame([("wide", 200_000, 10**12), ("after", 10**12 + 10, 10**12 + 20)], "n string, lo long, hi long")
    points = spark.range(0, 200_000, 7).selectExpr("id AS p").union(spark.range(50_000).selectExpr("CAST(5 AS long)"))
    points = points.union(spark.range(1000).selectExpr("200000 + id * 900000000")).union(spark.range(9, 12).selectExpr("1000000000000 + id"))
    got = ordering.interval_lookup(points, "p", narrow.union(wide), "lo", "hi")
    counts = {r["n"]: r["count"] for r in got.groupBy("n").count().collect()}
    assert got.where("p < lo OR p >= hi").count() == 0
    assert counts["wide"] == 1000 and counts["after"] == 2 and counts["2"] == 50_000
    assert sum(counts.values()) == len(range(0, 200_000, 7)) + 50_000 + 1000 + 2  # a point in the gap has none
