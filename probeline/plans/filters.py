"""Projections and filters on ``events``, ``orders``, ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeline.functions.columns import rounded
from probeline.operators import filters
from probeline.plans.fixtures import event_records, recordings
from probeline.plans.registry import query, r, table, with_ctes


@query(
    "p01_lead_selection",
    "SELECT event_id, event_type FROM events WHERE event_type = 'purchase'",
)
def lead_selection(spark, sf_dir):
    """No lead is called ``chase``; the first one containing it is used."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return filters.select_leads(events, "event_type", " CHASE")


@query(
    "p02_healthy_subjects",
    with_ctes(
        "od",
        "SELECT subject, record FROM od WHERE subject IN (SELECT subject FROM (SELECT *, row_number() OVER (PARTITION BY "
        "subject ORDER BY record) AS rn FROM od) WHERE rn = 1 AND contains(code, 'LOW'))",
    ),
)
def healthy_subjects(spark, sf_dir):
    kept = filters.healthy_subjects(recordings(spark, sf_dir), "subject", ["record"], "code", "LOW")
    return kept.select("subject", "record")


@query(
    "p03_session_names",
    "SELECT item, replace(replace(replace(lower(item), '-', ''), '_', ''), ' ', '') AS session, n FROM "
    "(SELECT o_orderpriority AS item, count(*) AS n FROM orders GROUP BY o_orderpriority UNION ALL "
    "SELECT p_name, count(*) FROM part GROUP BY p_name)",
)
def session_names(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("item"))
    names = names.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return names.unionByName(parts).withColumn("session", filters.normalised_session(F.col("item")))


@query(
    "p04_rate_mismatches",
    "SELECT event_id FROM events WHERE trunc(value) <> event_id % 50 AND user_id % 7 <> 0",
)
def rate_mismatches(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("user_id") % 7 != 0, F.col("event_id") % 50).alias("declared"),
        F.col("value").alias("measured"),
    )
    return filters.rate_mismatches(events, "declared", "measured").select("event_id")


@query(
    "p05_canonical_roles",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'enroll' WHEN 2 THEN 'probe' ELSE 'probe' END "
    "AS role FROM events",
)
def canonical_roles(spark, sf_dir):
    spelled = F.element_at(
        F.array(F.lit("Train "), F.lit("ENROL"), F.lit("test"), F.lit("False")), (F.col("event_id") % 4 + 1).cast("int")
    )
    events = table(spark, sf_dir, "events")
    return events.select("event_id", filters.canonical_role(spelled).alias("role"))


@query(
    "p06_unit_filter",
    with_ctes(
        "od",
        "SELECT subject, record FROM od WHERE status = 'F' AND subject NOT IN (SELECT c_custkey FROM customer WHERE "
        "c_mktsegment = 'BUILDING')",
    ),
)
def unit_filter(spark, sf_dir):
    excluded = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    excluded = excluded.select(F.col("c_custkey").alias("subject"))
    kept = filters.by_unit(recordings(spark, sf_dir), "status", "F", "subject", excluded)
    return kept.select("subject", "record")


@query(
    "p07_usable_records",
    "SELECT user_id, date, n AS n_samples FROM (SELECT user_id, ts::DATE AS date, count(*) AS n, stddev_pop(value) AS s, "
    "bool_or(isnan(v)) AS bad FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE value END AS v "
    "FROM events) GROUP BY ALL) WHERE n >= 3 AND NOT bad AND s >= 1e-5",
)
def usable_records(spark, sf_dir):
    """One recording per user and day; every 97th sample is missing."""
    events = table(spark, sf_dir, "events").select(
        "user_id",
        F.col("ts").cast("date").alias("date"),
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    )
    return filters.usable_records(events, ["user_id", "date"], "value", 3)


@query(
    "p08_label_codes",
    "SELECT p_name AS label, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part)",
)
def label_codes(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("label"))
    return filters.encode_labels(names, "label")


@query(
    "p08_encoded_rows",
    "SELECT vec_id, label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM embeddings",
)
def encoded_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return rows.join(filters.encode_labels(rows, "label"), "label")


@query(
    "p09_first_visit_content",
    "SELECT doc_id FROM (SELECT doc_id, doc_id % 3 AS visit, min(doc_id % 3) OVER (PARTITION BY lang, md5(text)) AS "
    "first_visit FROM documents) WHERE visit = first_visit",
)
def first_visit_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 3).alias("visit"), "text")
    return filters.first_visit_content(docs, "lang", "visit", F.col("text")).select("doc_id")


@query("p10_dated_records", with_ctes("od", "SELECT subject, record, date FROM od WHERE date IS NOT NULL"))
def dated_records(spark, sf_dir):
    return filters.dated(recordings(spark, sf_dir), "date").select("subject", "record", "date")


@query(
    "p11_zero_mean",
    with_ctes(
        "ev",
        f"SELECT record, {r('value - avg(value) OVER (PARTITION BY subject)')} AS value FROM ev",
    ),
)
def zero_mean(spark, sf_dir):
    centred = filters.zero_mean(event_records(spark, sf_dir).select("subject", "record", "value"), ["subject"], "value")
    return centred.select("record", rounded("value").alias("value"))
