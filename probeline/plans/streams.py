"""Streaming queries over ``events`` as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeline.functions.columns import rounded
from probeline.plans.registry import cte, query, r, table, with_ctes
from probeline.streaming import streams

cte(
    "es",
    "SELECT user_id, event_type, event_id, value, epoch_us(ts) AS us, (SELECT max(epoch_us(ts)) FROM events) AS top FROM events",
)


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return streams.event_stream(spark, sf_dir, "events.parquet", schema)


def windows_in_sql(size: int, slide: int) -> str:
    return (
        f"SELECT user_id, k * {slide} AS start_s, k * {slide} + {size} AS end_s, count(*) AS n, {r('sum(value)', 4)} AS total, min(value) AS "
        f"low, max(value) AS high FROM (SELECT *, unnest(range((us // 1000000 - {size}) // {slide} + 1, us // 1000000 // {slide} + 1)) AS k "
        f"FROM es) WHERE k * {slide} + {size} <= (top // 1000 - 3600000) / 1000 GROUP BY user_id, k"
    )


def _windows(spark, sf_dir, size, slide, name):
    out = streams.run_to_table(streams.sliding_windows(_stream(spark, sf_dir), ["user_id"], size, slide, "1 hour"), name)
    return out.withColumn("total", rounded("total", 4))


@query("st1_sliding_windows", with_ctes("es", windows_in_sql(7200, 3600)))
def sliding(spark, sf_dir):
    """Two-hour windows every hour."""
    return _windows(spark, sf_dir, "2 hours", "1 hour", "sliding")


@query("st1_tumbling_windows", with_ctes("es", windows_in_sql(21600, 21600)))
def tumbling(spark, sf_dir):
    return _windows(spark, sf_dir, "6 hours", None, "tumbling")


@query(
    "st2_sittings",
    with_ctes(
        "es",
        f"SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n, {r('sum(value)', 4)} AS total FROM (SELECT *, "
        "sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS sitting FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY "
        "user_id ORDER BY us, event_id) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM es)) GROUP BY user_id, sitting, top "
        "HAVING max(us) + 21600000000 <= (top // 1000 - 3600000) * 1000",
    ),
)
def sittings(spark, sf_dir):
    """Six hours without an event end a sitting."""
    out = streams.run_to_table(streams.sittings(_stream(spark, sf_dir), ["user_id"], "6 hours", "1 hour"), "sittings")
    return out.withColumn("total", rounded("total", 4))


@query(
    "st3_without_repeats",
    "SELECT DISTINCT user_id, event_type, floor(value)::BIGINT AS content FROM events",
)
def without_repeats(spark, sf_dir):
    stream = _stream(spark, sf_dir).withColumn("content", F.floor("value"))
    kept = streams.without_repeats(stream, ["user_id", "event_type", "content"], "60 days")
    return streams.run_to_table(kept.select("user_id", "event_type", "content"), "repeats")


@query(
    "st4_groups_of_k",
    "SELECT user_id, event_type, unnest(range(count(*) // 3)) AS group_no, 3::BIGINT AS n, 3::BIGINT AS n_own, 3::BIGINT AS n_once "
    "FROM events GROUP BY user_id, event_type",
)
def groups_of_k(spark, sf_dir):
    """Size of each group, members that are events of its own block, and members that are in no other group."""
    grouped = streams.groups_of(_stream(spark, sf_dir), ["user_id", "event_type"], "event_id", 3)
    out = streams.run_to_table(grouped, "groups")
    members = out.select("user_id", "event_type", "group_no", F.explode("members").alias("event_id"))
    uses = members.groupBy("event_id").agg(F.count(F.lit(1)).alias("uses"))
    events = table(spark, sf_dir, "events").select("event_id", F.struct("user_id", "event_type").alias("block"))
    own = F.col("block").eqNullSafe(F.struct("user_id", "event_type"))
    count = lambda c: F.count(F.when(c, F.lit(1)))
    return (
        members.join(uses, "event_id")
        .join(events, "event_id", "left")
        .groupBy("user_id", "event_type", "group_no")
        .agg(F.count(F.lit(1)).alias("n"), count(own).alias("n_own"), count(F.col("uses") == 1).alias("n_once"))
    )
