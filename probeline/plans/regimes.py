"""Record roles, session pooling, minute ranges and leakage audits on ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeline.functions.columns import rounded
from probeline.operators import fusion, intervals, roles
from probeline.plans.fixtures import event_records, minute_ranges, recordings
from probeline.plans.registry import cte, query, r, with_ctes
from probeline.session import cut_lineage

OUT = ("subject", "record", "role")


@query(
    "r01_single_cross_session",
    with_ctes(
        "od",
        "SELECT subject, record, CASE rn WHEN 1 THEN 'enroll' ELSE 'probe' END AS role FROM (SELECT *, row_number() "
        "OVER (PARTITION BY subject ORDER BY date, record) AS rn, count(*) OVER (PARTITION BY subject) AS n FROM od "
        "WHERE date IS NOT NULL) WHERE rn <= 2 AND n >= 2",
    ),
)
def single_cross_session(spark, sf_dir):
    return roles.single_cross_session(recordings(spark, sf_dir), "subject", "date", "record").select(*OUT)


cte("d1", "SELECT * FROM (SELECT *, min(date) OVER (PARTITION BY subject) AS day1 FROM ev) WHERE date = day1", ("ev",))
cte(
    "dd",
    "SELECT *, min(date) OVER w AS day1, max(date) OVER w AS last_day FROM od WHERE date IS NOT NULL "
    "WINDOW w AS (PARTITION BY subject)",
    ("od",),
)


@query(
    "r02_single_shot_short_term",
    with_ctes(
        "d1",
        "SELECT subject, record, CASE WHEN record = lo THEN 'enroll' ELSE 'probe' END AS role FROM (SELECT *, "
        "min(record) OVER (PARTITION BY subject) AS lo, count(*) OVER (PARTITION BY subject) AS n FROM d1) WHERE n >= 2",
    ),
)
def single_shot_short_term(spark, sf_dir):
    return roles.single_shot_short_term(event_records(spark, sf_dir), "subject", "date", "record").select(*OUT)


@query(
    "r03_leave_last_out_short_term",
    with_ctes(
        "d1",
        "SELECT subject, record, CASE WHEN record = hi THEN 'probe' ELSE 'enroll' END AS role FROM (SELECT *, "
        "max(record) OVER (PARTITION BY subject) AS hi, count(*) OVER (PARTITION BY subject) AS n FROM d1) WHERE n >= 2",
    ),
)
def leave_last_out_short_term(spark, sf_dir):
    return roles.leave_last_out_short_term(event_records(spark, sf_dir), "subject", "date", "record").select(*OUT)


_R04 = "SELECT subject, record, date, CASE WHEN date = day1 THEN 'enroll' ELSE 'probe' END AS role FROM dd WHERE day1 < last_day"
cte("r4", _R04, ("dd",))


@query("r04_single_shot_long_term", with_ctes("r4", "SELECT subject, record, role FROM r4"))
def single_shot_long_term(spark, sf_dir):
    return roles.single_shot_long_term(recordings(spark, sf_dir), "subject", "date", "record").select(*OUT)


@query(
    "r05_leave_last_out_long_term",
    with_ctes(
        "dd",
        "SELECT subject, record, CASE WHEN date = last_day THEN 'probe' ELSE 'enroll' END AS role FROM dd "
        "WHERE day1 < last_day",
    ),
)
def leave_last_out_long_term(spark, sf_dir):
    return roles.leave_last_out_long_term(recordings(spark, sf_dir), "subject", "date", "record").select(*OUT)


@query(
    "r06_custom_record_split",
    with_ctes(
        "od",
        "SELECT subject, record, (rn - 1)::INT AS position, unnest(CASE WHEN rn <= 2 THEN ['train', 'enroll'] WHEN "
        "rn BETWEEN 4 AND 5 THEN ['probe'] ELSE [] END) AS role FROM (SELECT *, row_number() OVER (PARTITION BY subject "
        "ORDER BY date, record) AS rn, count(*) OVER (PARTITION BY subject) AS n FROM od WHERE date IS NOT NULL) "
        "WHERE n >= 5",
    ),
)
def custom_record_split(spark, sf_dir):
    known = recordings(spark, sf_dir).where(F.col("date").isNotNull())
    out = roles.custom_record_split(known, "subject", ["date", "record"], train=[0, 1], probe=[3, 4])
    return out.select("subject", "record", "position", "role")


@query(
    "r07_recording_order",
    with_ctes(
        "od",
        "SELECT subject, record, row_number() OVER (PARTITION BY subject ORDER BY date IS NULL, date, record, code) - 1 "
        "AS order_no FROM od",
    ),
)
def recording_order(spark, sf_dir):
    placed = roles.recording_order(recordings(spark, sf_dir), "subject", "date", "record", "code")
    return placed.select("subject", "record", "order_no")


@query(
    "r08_visit_numbers",
    with_ctes(
        "ev",
        "SELECT subject, record, 'S' || dense_rank() OVER (PARTITION BY subject ORDER BY date) AS visit FROM ev",
    ),
)
def visit_numbers(spark, sf_dir):
    return roles.visit_numbers(event_records(spark, sf_dir), "subject", "date").select("subject", "record", "visit")


REQUIRED = ("click", "purchase", "view")
#: Every recording counts for a session only if it is long enough, so that some subjects lack one.
cte("ew", "SELECT *, CASE WHEN 4 * value >= 240 THEN session ELSE 'short' END AS kind FROM ev", ("ev",))


def _sessions(spark, sf_dir):
    """All recordings; those below a minimum length don't count for their session."""
    long = 4 * F.col("value") >= 240
    return event_records(spark, sf_dir).withColumn("session", F.when(long, F.col("session")).otherwise("short"))


@query(
    "r09_session_pooling",
    with_ctes(
        "ew",
        "SELECT subject, record, kind AS session FROM ew WHERE kind IN ('click', 'purchase', 'view') AND subject IN "
        "(SELECT subject FROM ew WHERE kind IN ('click', 'purchase', 'view') GROUP BY subject "
        "HAVING count(DISTINCT kind) = 3)",
    ),
)
def session_pooling(spark, sf_dir):
    pooled = roles.pooled_sessions(_sessions(spark, sf_dir), "subject", "session", REQUIRED)
    return pooled.select("subject", "record", "session")


@query(
    "r09_session_presence",
    with_ctes(
        "ew",
        "SELECT subject, array_to_string(list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(l, x)), "
        "',') AS missing, list_has_all(l, ['click', 'purchase', 'view']) AS kept FROM (SELECT subject, "
        "list(DISTINCT kind) AS l FROM ew GROUP BY subject)",
    ),
)
def session_presence(spark, sf_dir):
    return roles.session_presence(_sessions(spark, sf_dir), "subject", "session", REQUIRED)


_ROLE_OF_SESSION = (
    "CASE WHEN session IN ('click', 'view') THEN 'enroll' WHEN session IN ('purchase', 'error') THEN 'probe' END"
)


def _session_roles(df):
    role = F.when(F.col("session").isin("click", "view"), "enroll").when(
        F.col("session").isin("purchase", "error"), "probe"
    )
    return df.withColumn("role", role)


@query(
    "r10_same_visit_pairings",
    with_ctes(
        "ev",
        "SELECT subject, date, count_if(role = 'enroll')::BIGINT AS n_enroll, count_if(role = 'probe')::BIGINT AS "
        f"n_probe FROM (SELECT *, {_ROLE_OF_SESSION} AS role FROM ev) GROUP BY subject, date "
        "HAVING count_if(role = 'enroll') > 0 AND count_if(role = 'probe') > 0",
    ),
)
def same_visit_pairings(spark, sf_dir):
    return roles.same_visit_pairings(_session_roles(event_records(spark, sf_dir)), "subject", "date", "role")


@query(
    "r10_shared_sessions",
    "SELECT code FROM (SELECT o_orderpriority AS code FROM orders WHERE o_orderstatus = 'F' INTERSECT "
    "SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'O')",
)
def shared_sessions(spark, sf_dir):
    rows = recordings(spark, sf_dir).withColumn(
        "role", F.when(F.col("status") == "F", "enroll").when(F.col("status") == "O", "probe")
    )
    return roles.shared_sessions(rows, "code", "role")


@query(
    "r10_mixed_collections",
    with_ctes("od", "SELECT subject FROM od GROUP BY subject HAVING count(DISTINCT status) > 1"),
)
def mixed_collections(spark, sf_dir):
    return roles.mixed_collections(recordings(spark, sf_dir), "subject", "status")


@query(
    "r11_first_records",
    with_ctes(
        "ev",
        "SELECT subject, min(record) AS record, arg_min(session, record) AS session FROM ev GROUP BY subject",
    ),
)
def first_records(spark, sf_dir):
    return roles.first_records(event_records(spark, sf_dir), "subject", ["record"], "session")


@query(
    "r11_all_records",
    with_ctes(
        "od ev",
        "SELECT subject, record, 'orders' AS source FROM od UNION ALL SELECT subject, record, 'events' FROM ev",
    ),
)
def all_records(spark, sf_dir):
    first = recordings(spark, sf_dir).select("subject", "record", F.lit("orders").alias("source"))
    second = event_records(spark, sf_dir).select("subject", "record", F.lit("events").alias("source"))
    return first.unionByName(second)


RANGES = {"train": [(0.0, 7200.0), (10080.0, 14400.0)], "probe": [(20160.0, 28800.0)]}


@query(
    "r12_role_load",
    with_ctes(
        "ev",
        "SELECT subject, record, unnest(CASE WHEN minute < 7200 OR (minute >= 10080 AND minute < 14400) THEN "
        "['train', 'enroll'] WHEN minute >= 20160 AND minute < 28800 THEN ['probe'] ELSE [] END) AS role FROM ev",
    ),
)
def role_load(spark, sf_dir):
    """No enrollment ranges are given, so the training ranges enroll as well."""
    return roles.load_roles(event_records(spark, sf_dir), "minute", RANGES).select(*OUT)


_LEAKY = "CASE record % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'enroll' ELSE 'probe' END"


def _leaky(df):
    third = F.col("record") % 3
    return df.withColumn("role", F.when(third == 0, "train").when(third == 1, "enroll").otherwise("probe"))


@query(
    "r13_partition_problems",
    with_ctes(
        "ev",
        "SELECT f.subject, f.n_shared_files, count(l.record) AS n_late_sources FROM (SELECT subject, "
        "count_if(p > 0 AND s > 0)::BIGINT AS n_shared_files, min(first_probe) AS first_probe FROM (SELECT subject, session, "
        "count_if(role = 'probe') AS p, count_if(role <> 'probe') AS s, min(date) FILTER (role = 'probe') AS first_probe "
        f"FROM (SELECT *, {_LEAKY} AS role FROM ev) GROUP BY subject, session) GROUP BY subject) f LEFT JOIN "
        f"(SELECT *, {_LEAKY} AS role FROM ev) l ON l.subject = f.subject AND l.role <> 'probe' AND "
        "l.date > f.first_probe GROUP BY f.subject, f.n_shared_files",
    ),
)
def partition_problems(spark, sf_dir):
    log = _leaky(event_records(spark, sf_dir))
    return roles.partition_problems(log, "subject", "session", "date", "role")


@query(
    "r14_causality_audit",
    with_ctes(
        "ev",
        "SELECT subject, count_if(role = 'enroll')::BIGINT AS n_enroll, count_if(role = 'probe')::BIGINT AS n_probe, "
        "coalesce(max((date, record)) FILTER (role = 'enroll') >= min((date, record)) FILTER (role = 'probe'), false) "
        f"AS violates FROM (SELECT *, {_LEAKY} AS role FROM ev WHERE subject % 2 = 0 UNION ALL SELECT *, CASE WHEN "
        "minute < 20160 THEN 'enroll' ELSE 'probe' END FROM ev WHERE subject % 2 = 1) GROUP BY subject",
    ),
)
def causality_audit(spark, sf_dir):
    """Even subjects have a leaky assignment, odd ones split at two weeks."""
    rows = _leaky(event_records(spark, sf_dir))
    clean = F.when(F.col("minute") < 20160, "enroll").otherwise("probe")
    mixed = rows.withColumn("role", F.when(F.col("subject") % 2 == 0, F.col("role")).otherwise(clean))
    return roles.causality_audit(mixed, "subject", "date", "record", "role")


cte(
    "sd",
    "SELECT subject, date_diff('day', max(date) FILTER (role = 'enroll'), min(date) FILTER (role = 'probe'))::INT "
    "AS days FROM r4 GROUP BY subject",
    ("r4",),
)


def _separations(spark, sf_dir):
    rows = roles.single_shot_long_term(recordings(spark, sf_dir), "subject", "date", "record")
    return roles.separation_days(rows, "subject", "date", "role")


@query("r15_separation_days", with_ctes("sd", "SELECT subject, days FROM sd"))
def separation_days(spark, sf_dir):
    return _separations(spark, sf_dir)


@query(
    "r16_separation_summary",
    with_ctes(
        "sd",
        "SELECT count(days) AS n_dated, count_if(days = 0)::BIGINT AS n_same_day, count_if(days <> 0)::BIGINT AS "
        "n_other_day, min(days)::BIGINT AS min_days, max(days)::BIGINT AS max_days, median(days)::DOUBLE AS median_days FROM sd",
    ),
)
def separation_summary(spark, sf_dir):
    return roles.separation_summary(_separations(spark, sf_dir))


# --- minute ranges ---------------------------------------------------------------------------------

KEYS = ["subject", "role"]


@query(
    "r17_invalid_ranges",
    with_ctes(
        "rg",
        "SELECT subject, record, CASE WHEN start_min - 600 < 0 THEN 'negative start' ELSE 'empty' END AS reason FROM rg "
        "WHERE start_min - 600 < 0 OR start_min - 600 >= end_min - 640",
    ),
)
def invalid_ranges(spark, sf_dir):
    """Ranges moved ten hours back and cut by forty minutes, so some become invalid."""
    moved = minute_ranges(spark, sf_dir).select(
        "subject", "record", (F.col("start_min") - 600).alias("start_min"), (F.col("end_min") - 640).alias("end_min")
    )
    return intervals.invalid_ranges(moved).select("subject", "record", "reason")


@query(
    "r17_overlapping_ranges",
    with_ctes(
        "rg",
        "SELECT subject, role, record FROM (SELECT *, max(end_min) OVER (PARTITION BY subject, role ORDER BY start_min, "
        "end_min, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM rg) WHERE start_min < seen",
    ),
)
def overlapping_ranges(spark, sf_dir):
    return intervals.overlapping_ranges(minute_ranges(spark, sf_dir), KEYS, "record").select("subject", "role", "record")


cte("rd", "SELECT DISTINCT subject, role, start_min, end_min FROM rg WHERE end_min > start_min", ("rg",))


def islands(source: str, keys: str) -> str:
    """Gaps-and-islands over ``source`` in SQL."""
    return (
        f"SELECT {keys}, min(start_min) AS start_min, max(end_min) AS end_min FROM (SELECT *, sum(fresh) OVER "
        f"(PARTITION BY {keys} ORDER BY start_min, end_min) AS island FROM (SELECT *, CASE WHEN start_min > "
        f"coalesce(max(end_min) OVER (PARTITION BY {keys} ORDER BY start_min, end_min ROWS BETWEEN UNBOUNDED PRECEDING "
        f"AND 1 PRECEDING), '-infinity'::DOUBLE) THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT {keys}, start_min, "
        f"end_min FROM {source}))) GROUP BY {keys}, island"
    )


def crossing(first: str, second: str) -> str:
    return (
        "SELECT a.subject, greatest(a.start_min, b.start_min) AS start_min, least(a.end_min, b.end_min) AS end_min "
        f"FROM {first} a JOIN {second} b ON a.subject = b.subject AND a.start_min < b.end_min AND b.start_min < a.end_min"
    )


cte("mr", islands("rd", "subject, role"), ("rd",))
for _role in ("train", "enroll", "probe"):
    cte(f"m_{_role}", f"SELECT subject, start_min, end_min FROM mr WHERE role = '{_role}'", ("mr",))
cte("x_tp", crossing("m_train", "m_probe"), ("m_train", "m_probe"))
cte("i_tp", islands("x_tp", "subject"), ("x_tp",))


def _valid(spark, sf_dir):
    return minute_ranges(spark, sf_dir).where(F.col("end_min") > F.col("start_min"))


def _coverage(spark, sf_dir, role):
    own = _valid(spark, sf_dir).where(F.col("role") == role).select("subject", "start_min", "end_min")
    return intervals.coalesce_ranges(own, ["subject"])


@query(
    "r18_coalesced_ranges",
    with_ctes("mr", "SELECT subject, role, start_min, end_min FROM mr"),
)
def coalesced_ranges(spark, sf_dir):
    return intervals.coalesce_ranges(_valid(spark, sf_dir), KEYS)


@query(
    "r19_range_intersections",
    with_ctes("i_tp", "SELECT subject, start_min, end_min FROM i_tp"),
)
def range_intersections(spark, sf_dir):
    return intervals.intersect_ranges(
        _coverage(spark, sf_dir, "train"), _coverage(spark, sf_dir, "probe"), ["subject"]
    )


_GAP = "greatest(b.start_min - a.end_min, a.start_min - b.end_min, 0)"


@query(
    "r20_range_separation",
    with_ctes(
        "m_train m_probe",
        f"SELECT subject, {r(f'min({_GAP})')} AS gap_min FROM m_train a FULL JOIN m_probe b USING (subject) "
        "GROUP BY subject",
    ),
)
def range_separation(spark, sf_dir):
    gaps = intervals.range_separation(
        _coverage(spark, sf_dir, "train"), _coverage(spark, sf_dir, "probe"), ["subject"]
    )
    return gaps.withColumn("gap_min", rounded("gap_min"))


@query(
    "r21_covered_minutes",
    with_ctes("mr", f"SELECT subject, role, {r('sum(end_min - start_min)', 4)} AS covered_min FROM mr GROUP BY subject, role"),
)
def covered_minutes(spark, sf_dir):
    covered = intervals.covered_minutes(intervals.coalesce_ranges(_valid(spark, sf_dir), KEYS), KEYS)
    return covered.withColumn("covered_min", rounded("covered_min", 4))


cte("xs", "SELECT subject, start_min, end_min FROM mr WHERE role IN ('train', 'enroll')", ("mr",))
cte("src", islands("xs", "subject"), ("xs",))
cte("x_te", crossing("m_train", "m_enroll"), ("m_train", "m_enroll"))
cte("x_sp", crossing("src", "m_probe"), ("src", "m_probe"))
cte("i_te", islands("x_te", "subject"), ("x_te",))
cte("i_sp", islands("x_sp", "subject"), ("x_sp",))
GUARD = 30.0


@query(
    "r22_range_audit",
    with_ctes(
        "mr src m_probe i_te i_sp",
        f"SELECT subject, {r('train_min', 4)} AS train_min, {r('enroll_min', 4)} AS enroll_min, "
        f"{r('probe_min', 4)} AS probe_min, {r('coalesce(te, 0)', 4)} AS shared_min, {r('coalesce(sp, 0)', 4)} AS leaked_min, "
        f"{r('gap')} AS gap_min, coalesce(gap < {GUARD}, false) AS guard_broken, coalesce(first_probe < last_source, false) "
        "AS order_broken FROM (SELECT subject, coalesce(sum(end_min - start_min) FILTER (role = 'train'), 0) AS train_min, "
        "coalesce(sum(end_min - start_min) FILTER (role = 'enroll'), 0) AS enroll_min, "
        "coalesce(sum(end_min - start_min) FILTER (role = 'probe'), 0) AS probe_min, "
        "max(end_min) FILTER (role <> 'probe') AS last_source, min(start_min) FILTER (role = 'probe') AS first_probe "
        "FROM mr WHERE role <> 'other' GROUP BY subject) LEFT JOIN (SELECT subject, sum(end_min - start_min) AS te FROM i_te "
        "GROUP BY subject) USING (subject) LEFT JOIN (SELECT subject, sum(end_min - start_min) AS sp FROM i_sp "
        f"GROUP BY subject) USING (subject) LEFT JOIN (SELECT subject, min({_GAP}) AS gap FROM src a JOIN m_probe b "
        "USING (subject) GROUP BY subject) USING (subject)",
    ),
)
def range_audit(spark, sf_dir):
    ranges = cut_lineage(_valid(spark, sf_dir).where(F.col("role") != "other"))
    report = intervals.audit_ranges(ranges, ["subject"], "role", GUARD)
    for column in ("train_min", "enroll_min", "probe_min", "shared_min", "leaked_min"):
        report = report.withColumn(column, rounded(column, 4))
    return report.withColumn("gap_min", rounded("gap_min"))


# --- provenance ------------------------------------------------------------------------------------

BLOCK = ["subject", "session", "date"]
cte(
    "pv",
    "SELECT subject, record AS obs_id, session AS session_id, CASE WHEN subject % 3 = 0 AND session = 'error' THEN NULL "
    "ELSE date END AS acquisition_time, record % 1000 AS acquisition_order, session || '-' || (record % 2) AS record_id, "
    "'seg' || (record % 3) AS source_segment_id, (record % 3)::DOUBLE AS source_segment_order, record // 7 AS beat_ordinal, "
    "CASE WHEN subject % 5 = 0 AND record % 11 = 0 THEN -1 ELSE (record * 37) % 101 END AS rpeak_index FROM ev",
    ("ev",),
)


def provenance(spark, sf_dir):
    ev = event_records(spark, sf_dir)
    rec = F.col("record")
    return ev.select(
        "subject",
        rec.alias("obs_id"),
        F.col("session").alias("session_id"),
        F.when(~((F.col("subject") % 3 == 0) & (F.col("session") == "error")), F.col("date")).alias("acquisition_time"),
        (rec % 1000).alias("acquisition_order"),
        F.concat("session", F.lit("-"), rec % 2).alias("record_id"),
        F.concat(F.lit("seg"), rec % 3).alias("source_segment_id"),
        (rec % 3).cast("double").alias("source_segment_order"),
        F.floor(rec / 7).alias("beat_ordinal"),
        F.when((F.col("subject") % 5 == 0) & (rec % 11 == 0), F.lit(-1)).otherwise((rec * 37) % 101).alias("rpeak_index"),
    )


@query(
    "r23_block_ordinals",
    with_ctes(
        "ev",
        "SELECT subject, record, row_number() OVER (PARTITION BY subject, session, date ORDER BY minute, record) - 1 AS "
        "beat_ordinal FROM ev",
    ),
)
def block_ordinals(spark, sf_dir):
    ev = event_records(spark, sf_dir)
    placed = roles.block_ordinals(ev, BLOCK, ["minute", "record"], F.floor(F.col("minute") / 60))
    return placed.select("subject", "record", "beat_ordinal")


@query(
    "r23_provenance_problems",
    with_ctes(
        "pv",
        "SELECT count_if(record_id IS NULL)::BIGINT AS n_null_record_id, count_if(session_id IS NULL)::BIGINT AS "
        "n_null_session_id, count_if(acquisition_time IS NULL)::BIGINT AS n_null_acquisition_time FROM pv",
    ),
)
def provenance_problems(spark, sf_dir):
    return roles.provenance_problems(provenance(spark, sf_dir), ["record_id", "session_id", "acquisition_time"])


@query(
    "r24_source_order",
    with_ctes(
        "pv",
        "SELECT subject, obs_id, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN dated THEN "
        "date_diff('day', DATE '1970-01-01', acquisition_time) ELSE acquisition_order END, acquisition_order, record_id, "
        "source_segment_order, source_segment_id, CASE WHEN peaks THEN rpeak_index ELSE beat_ordinal END, obs_id) AS source_no "
        "FROM (SELECT *, bool_and(acquisition_time IS NOT NULL) OVER (PARTITION BY subject) AS dated, "
        "bool_and(rpeak_index >= 0) OVER (PARTITION BY subject) AS peaks FROM pv)",
    ),
)
def source_order(spark, sf_dir):
    placed = fusion.source_order(provenance(spark, sf_dir), ["subject"])
    return placed.select("subject", "obs_id", "source_no")


@query(
    "r24_source_order_by_time",
    with_ctes(
        "ev",
        "SELECT subject, record AS obs_id, row_number() OVER (PARTITION BY subject ORDER BY ts, record % 1000, record) AS source_no FROM ev",
    ),
)
def source_order_by_time(spark, sf_dir):
    """Several recordings of a subject on one day, whose acquisition order is not their order in time."""
    rec = F.col("record")
    rows = event_records(spark, sf_dir).select(
        "subject",
        rec.alias("obs_id"),
        F.col("ts").alias("acquisition_time"),
        (rec % 1000).alias("acquisition_order"),
        rec.alias("record_id"),
        F.lit("all").alias("source_segment_id"),
        F.lit(0.0).alias("source_segment_order"),
        rec.alias("beat_ordinal"),
        rec.alias("rpeak_index"),
    )
    return fusion.source_order(rows, ["subject"]).select("subject", "obs_id", "source_no")


@query(
    "r25_source_blocks",
    with_ctes(
        "pv",
        "SELECT session_id, record_id, source_segment_id, count(*) AS n_rows FROM pv GROUP BY ALL",
    ),
)
def source_blocks(spark, sf_dir):
    return roles.source_blocks(provenance(spark, sf_dir), ["session_id", "record_id", "source_segment_id"])
