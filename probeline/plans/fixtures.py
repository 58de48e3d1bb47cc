"""How the test tables stand in for recordings, samples and ranges; the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from probeline.functions.ordering import numbered
from probeline.plans.registry import cte, table

#: Orders as dated recordings; orders of status P are undated.
cte(
    "od",
    "SELECT o_custkey AS subject, o_orderkey AS record, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END "
    "AS date, o_orderstatus AS status, o_orderpriority AS code FROM orders",
)
#: Events as recordings of a user; the event type is the session or lead.
cte(
    "ev",
    "SELECT user_id AS subject, event_id AS record, ts::DATE AS date, event_type AS session, value, "
    "date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 60000000.0::DOUBLE AS minute, ts FROM events",
)
#: Events as minute ranges of a user; the range length is four times the value.
cte(
    "rg",
    "SELECT subject, record, minute AS start_min, minute + 4 * value AS end_min, CASE session WHEN 'click' THEN "
    "'train' WHEN 'view' THEN 'enroll' WHEN 'purchase' THEN 'probe' ELSE 'other' END AS role FROM ev",
    ("ev",),
)
#: Events as one long recording per type: samples in time order.
cte(
    "sp",
    "SELECT event_type AS record, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, "
    "value, user_id FROM events",
)


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").alias("subject"),
        F.col("o_orderkey").alias("record"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("date"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("code"),
    )


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return events.select(
        F.col("user_id").alias("subject"),
        F.col("event_id").alias("record"),
        F.col("ts").cast("date").alias("date"),
        F.col("event_type").alias("session"),
        "value",
        (micros / F.lit(60000000.0)).alias("minute"),
        "ts",
    )


def minute_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = (
        F.when(F.col("session") == "click", "train")
        .when(F.col("session") == "view", "enroll")
        .when(F.col("session") == "purchase", "probe")
        .otherwise("other")
    )
    return event_records(spark, sf_dir).select(
        "subject",
        "record",
        F.col("minute").alias("start_min"),
        (F.col("minute") + 4 * F.col("value")).alias("end_min"),
        role.alias("role"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long recordings ``record, idx, value, user_id``; numbered in day buckets, not per recording."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("record"), "ts", "event_id", "value", "user_id"
    )
    placed = numbered(events, ["record"], ["ts", "event_id"], F.col("ts").cast("date"), "__rn")
    return placed.select("record", (F.col("__rn") - 1).alias("idx"), "value", "user_id")
