"""Which recordings of a subject enroll and which probe, and audits of that choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from probeline.functions.ordering import exact_percentiles, numbered
from probeline.operators.templates import first_per_key


#: One column, or several of which a later one settles ties of those before it.
Order = str | Sequence[str]


def _columns(order: Order) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _place(order: Order) -> Column:
    return F.struct(*_columns(order))


def _subject_days(records: DataFrame, subject: str, date: str, order: Order) -> DataFrame:
    """First and last day of each subject with that day's first, last and number of records.

    Two levels of aggregates that combine map-side; a subject with very many records is spread by day.
    Undated records take no part in an ordered regime.
    """
    days = records.where(F.col(date).isNotNull()).groupBy(subject, date).agg(
        F.min(_place(order)).alias("lo"), F.max(_place(order)).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    day = F.struct(F.col(date).alias("day"), "lo", "hi", "n")
    return days.groupBy(subject).agg(
        F.min(day).alias("__first"), F.max(day).alias("__last"), F.count(F.lit(1)).alias("__days")
    )


def single_cross_session(records: DataFrame, subject: str, date: str, order: Order) -> DataFrame:
    """First record enrolls, second probes."""
    known = records.where(F.col(date).isNotNull())
    two = first_per_key(known, [subject], [date, *_columns(order)], 2, "__rn")
    both = F.count(F.lit(1)).over(Window.partitionBy(subject))  # at most two rows
    role = F.when(F.col("__rn") == 1, "enroll").otherwise("probe")
    return two.withColumn("__n", both).where(F.col("__n") == 2).withColumn("role", role).drop("__rn", "__n")


def _day_regime(records, subject, date, order, eligible: Column, enroll: Column, probe: Column) -> DataFrame:
    facts = _subject_days(records, subject, date, order).where(eligible)
    role = F.when(enroll, "enroll").when(probe, "probe")
    joined = records.where(F.col(date).isNotNull()).join(facts, subject).withColumn("role", role)
    return joined.where(F.col("role").isNotNull()).drop("__first", "__last", "__days")


def single_shot_short_term(records: DataFrame, subject: str, date: str, order: Order) -> DataFrame:
    """First record of the first day enrolls, the rest of that day probes. ``order`` may be several columns: of records
    with one order value the next column (the record's id) tells which is first."""
    day = F.col(date) == F.col("__first.day")
    first = _place(order) == F.col("__first.lo")
    return _day_regime(records, subject, date, order, F.col("__first.n") >= 2, day & first, day & ~first)


def leave_last_out_short_term(records: DataFrame, subject: str, date: str, order: Order) -> DataFrame:
    """The last record of the first day probes, the others of that day enroll. ``order`` as in ``single_shot_short_term``."""
    day = F.col(date) == F.col("__first.day")
    last = _place(order) == F.col("__first.hi")
    return _day_regime(records, subject, date, order, F.col("__first.n") >= 2, day & ~last, day & last)


def single_shot_long_term(records: DataFrame, subject: str, date: str, order: Order) -> DataFrame:
    """The first day enrolls, all later days probe."""
    day = F.col(date) == F.col("__first.day")
    return _day_regime(records, subject, date, order, F.col("__days") >= 2, day, ~day)


def leave_last_out_long_term(records: DataFrame, subject: str, date: str, order: Order) -> DataFrame:
    """The last day probes, all days before it enroll."""
    day = F.col(date) == F.col("__last.day")
    return _day_regime(records, subject, date, order, F.col("__days") >= 2, ~day, day)


REGIMES = {
    "single-cross-session": single_cross_session,
    "single-shot-short-term": single_shot_short_term,
    "leave-last-out-short-term": leave_last_out_short_term,
    "single-shot-long-term": single_shot_long_term,
    "leave-last-out-long-term": leave_last_out_long_term,
}


def custom_record_split(
    records: DataFrame,
    subject: str,
    order: Sequence[Column | str],
    train: Sequence[int],
    probe: Sequence[int],
    enroll: Sequence[int] | None = None,
) -> DataFrame:
    """Records by zero-based position. Enrollment reuses training if not given; probe positions must be
    new; a subject needs the largest position."""
    enroll = list(train) if enroll is None else list(enroll)
    if set(probe) & (set(train) | set(enroll)):
        raise ValueError("probe positions must differ from training and enrollment positions")
    if any(p < 0 for p in [*train, *enroll, *probe]):
        raise ValueError("positions start at zero")
    last = max([*train, *enroll, *probe])
    first = first_per_key(records, [subject], list(order), last + 1, "__rn")
    held = F.max("__rn").over(Window.partitionBy(subject))  # at most last + 1 rows
    roles = [
        F.when((F.col("__rn") - 1).isin(*chosen), F.lit(name))
        for name, chosen in (("train", train), ("enroll", enroll), ("probe", probe))
    ]
    return (
        first.withColumn("__held", held)
        .where(F.col("__held") == last + 1)
        .withColumn("position", (F.col("__rn") - 1).cast("int"))
        .withColumn("role", F.explode(F.array_compact(F.array(*roles))))
        .drop("__rn", "__held")
    )


def recording_order(records: DataFrame, subject: str, date: str, number: str, name: str) -> DataFrame:
    """Deterministic order per subject: dated first, then date, record number, name (``order_no`` from 0)."""
    month = F.floor(F.unix_date(F.col(date)) / 30)
    bucket = F.coalesce(month, F.lit(2**31))  # undated records come last
    order = [F.col(date).isNull(), date, number, name]
    placed = numbered(records, [subject], order, bucket, "order_no")
    return placed.withColumn("order_no", F.col("order_no") - 1)


def visit_numbers(records: DataFrame, subject: str, date: str) -> DataFrame:
    """Visits S1, S2, … from a subject's distinct dates."""
    days = records.select(subject, date).distinct()
    placed = numbered(days, [subject], [date], F.floor(F.unix_date(F.col(date)) / 30), "__v")
    return records.join(placed, [subject, date]).withColumn("visit", F.concat(F.lit("S"), "__v")).drop("__v")


def session_presence(records: DataFrame, subject: str, session: str, required: Sequence[str]) -> DataFrame:
    """Per subject, whether it has every required session and which ones are missing."""
    flags = [F.bool_or(F.col(session) == name).alias(f"__{i}") for i, name in enumerate(required)]
    facts = records.groupBy(subject).agg(*flags)
    missing = F.concat_ws(",", *[F.when(~F.col(f"__{i}"), F.lit(n)) for i, n in enumerate(required)])
    return facts.select(subject, missing.alias("missing"), (missing == "").alias("kept"))


def pooled_sessions(records: DataFrame, subject: str, session: str, required: Sequence[str]) -> DataFrame:
    """Rows of the required sessions, only for subjects present in all of them."""
    kept = session_presence(records, subject, session, required).where("kept").select(subject)
    return records.where(F.col(session).isin(*required)).join(kept, subject, "left_semi")


def same_visit_pairings(rows: DataFrame, subject: str, visit: str, role: str) -> DataFrame:
    """Subject visits that serve both enrollment and probe."""
    facts = rows.groupBy(subject, visit).agg(
        F.count_if(F.col(role) == "enroll").alias("n_enroll"), F.count_if(F.col(role) == "probe").alias("n_probe")
    )
    return facts.where((F.col("n_enroll") > 0) & (F.col("n_probe") > 0))


def shared_sessions(rows: DataFrame, session: str, role: str) -> DataFrame:
    """Session names used by both roles."""
    side = lambda name: rows.where(F.col(role) == name).select(session)
    return side("enroll").intersect(side("probe"))


def mixed_collections(rows: DataFrame, subject: str, collection: str) -> DataFrame:
    """Subjects whose rows come from more than one collection."""
    facts = rows.groupBy(subject).agg(F.min(collection).alias("__a"), F.max(collection).alias("__b"))
    return facts.where(F.col("__a") != F.col("__b")).select(subject)


def first_records(records: DataFrame, subject: str, order: Sequence[str], *kept: str) -> DataFrame:
    """Each subject's first record only, as one map-side combined aggregate."""
    first = records.groupBy(subject).agg(F.min(F.struct(*order, *kept)).alias("f"))
    return first.select(subject, *[F.col(f"f.{c}").alias(c) for c in dict.fromkeys([*order, *kept])])


def load_roles(samples: DataFrame, minute: str, ranges: dict[str, Sequence[tuple[float, float]]]) -> DataFrame:
    """Samples with each role whose minute ranges hold them; without enrollment ranges, training is used.

    The handful of given ranges become literal predicates, so the scan can prune on them.
    """
    roles = {**ranges, "enroll": ranges.get("enroll") or ranges["train"]}
    m = F.col(minute)

    def inside(spans):
        hit = F.lit(False)
        for start, end in spans:
            hit = hit | ((m >= start) & (m < end))
        return hit

    tags = F.array_compact(F.array(*[F.when(inside(spans), F.lit(name)) for name, spans in roles.items()]))
    anywhere = F.lit(False)
    for spans in roles.values():
        anywhere = anywhere | inside(spans)
    return samples.where(anywhere).withColumn("role", F.explode(tags))


def partition_problems(log: DataFrame, subject: str, file: str, date: str, role: str) -> DataFrame:
    """Per subject: files that serve a source role and the probe, and source records after the first probe.

    Aggregates by file first, so no pair of records is formed.
    """
    probe = F.col(role) == "probe"
    files = log.groupBy(subject, file).agg(
        F.count_if(probe).alias("p"),
        F.count_if(~probe).alias("s"),
        F.min(F.when(probe, F.col(date))).alias("first_probe"),
    )
    facts = files.groupBy(subject).agg(
        F.count_if((F.col("p") > 0) & (F.col("s") > 0)).alias("n_shared_files"),
        F.min("first_probe").alias("first_probe"),
    )
    late = log.where(~probe).join(facts.select(subject, "first_probe"), subject)
    late = late.where(F.col(date) > F.col("first_probe")).groupBy(subject).agg(F.count(F.lit(1)).alias("n_late_sources"))
    return facts.join(late, subject, "left").select(
        subject, "n_shared_files", F.coalesce("n_late_sources", F.lit(0)).cast("bigint").alias("n_late_sources")
    )


def causality_audit(rows: DataFrame, subject: str, date: str, position: str, role: str) -> DataFrame:
    """Per subject: does the latest enrollment come before the earliest probe?"""
    place = F.struct(F.col(date).alias("d"), F.col(position).alias("p"))
    enroll, probe = F.col(role) == "enroll", F.col(role) == "probe"
    facts = rows.groupBy(subject).agg(
        F.max(F.when(enroll, place)).alias("e"), F.min(F.when(probe, place)).alias("p"),
        F.count_if(enroll).alias("n_enroll"), F.count_if(probe).alias("n_probe"),
    )
    broken = F.coalesce(F.col("e") >= F.col("p"), F.lit(False))
    return facts.select(subject, "n_enroll", "n_probe", broken.alias("violates"))


def separation_days(rows: DataFrame, subject: str, date: str, role: str) -> DataFrame:
    """Whole days from the last enrollment to the first probe; NULL if either is undated."""
    last = F.max(F.when(F.col(role) == "enroll", F.col(date)))
    first = F.min(F.when(F.col(role) == "probe", F.col(date)))
    return rows.groupBy(subject).agg(F.date_diff(first, last).alias("days"))


def separation_summary(separations: DataFrame, days: str = "days") -> DataFrame:
    counts = separations.agg(
        F.count(days).alias("n_dated"),
        F.count_if(F.col(days) == 0).alias("n_same_day"),
        F.count_if(F.col(days) != 0).alias("n_other_day"),
        F.min(days).cast("bigint").alias("min_days"),
        F.max(days).cast("bigint").alias("max_days"),
    )
    middle = exact_percentiles(separations.select(F.col(days).cast("double").alias(days)), [], days, {"median_days": 0.5})
    return counts.crossJoin(F.broadcast(middle))  # one row each


def block_ordinals(rows: DataFrame, block: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Provenance: place of each row in its source block, from 0."""
    placed = numbered(rows, block, order, bucket, "__rn")
    return placed.withColumn("beat_ordinal", F.col("__rn") - 1).drop("__rn")


def provenance_problems(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """Number of missing values per required provenance column."""
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_null_{c}") for c in required])


def source_blocks(rows: DataFrame, block: Sequence[str]) -> DataFrame:
    return rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n_rows"))
