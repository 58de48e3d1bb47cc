"""Roles, ranges, signals, statistics, sources and streams on small tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probeline.functions import stats
from probeline.operators import covariates, encodings, filters, fusion, inference, intervals, roles, signal, splits, tables
from probeline.sources import readers, sinks
from probeline.streaming import streams

D = dt.date


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("a", D(2020, 1, 1), 1), ("a", D(2020, 1, 1), 2), ("a", D(2020, 1, 1), 3), ("a", D(2020, 3, 1), 4), ("a", None, 5),
        ("b", D(2020, 1, 1), 6), ("c", None, 7), ("c", None, 8), ("d", D(2020, 1, 2), 9), ("d", D(2020, 1, 5), 10),
    ]
    return spark.createDataFrame(rows, "subject string, date date, record int").cache()


@pytest.mark.parametrize(
    "regime, enroll, probe",
    [
        ("single-cross-session", {1, 9}, {2, 10}),
        ("single-shot-short-term", {1}, {2, 3}),
        ("leave-last-out-short-term", {1, 2}, {3}),
        ("single-shot-long-term", {1, 2, 3, 9}, {4, 10}),
        ("leave-last-out-long-term", {1, 2, 3, 9}, {4, 10}),
    ],
)
def test_regimes(records, regime, enroll, probe):
    rows = roles.REGIMES[regime](records, "subject", "date", "record").collect()
    assert {r["record"] for r in rows if r["role"] == "enroll"} == enroll
    assert {r["record"] for r in rows if r["role"] == "probe"} == probe
    assert len(rows) == len(enroll) + len(probe)


def test_custom_positions(records):
    rows = roles.custom_record_split(records.where("date is not null"), "subject", ["date", "record"], train=[0], probe=[3])
    assert {(r["record"], r["role"]) for r in rows.collect()} == {(1, "train"), (1, "enroll"), (4, "probe")}
    with pytest.raises(ValueError):
        roles.custom_record_split(records, "subject", ["date"], train=[0], probe=[0])


def test_order_and_visits(records):
    placed = roles.recording_order(records, "subject", "date", "record", "record")
    assert [r["record"] for r in placed.where("subject = 'a'").orderBy("order_no").collect()] == [1, 2, 3, 4, 5]
    visits = roles.visit_numbers(records.where("date is not null"), "subject", "date")
    assert {r["visit"] for r in visits.where("record = 4").collect()} == {"S2"}


def test_undated_separation_is_null(spark):
    rows = spark.createDataFrame(
        [("a", D(2020, 1, 1), "enroll"), ("a", D(2020, 1, 4), "probe"), ("b", None, "enroll"), ("b", D(2020, 1, 4), "probe")],
        "subject string, date date, role string",
    )
    got = roles.separation_days(rows, "subject", "date", "role")
    assert {r["subject"]: r["days"] for r in got.collect()} == {"a": 3, "b": None}
    summary = roles.separation_summary(got).first()
    assert (summary["n_dated"], summary["median_days"]) == (1, 3.0)


def test_unknown_role_is_an_error(spark):
    df = spark.createDataFrame([("Enrol",), ("TEST",)], "r string")
    assert [x["c"] for x in df.select(filters.canonical_role(F.col("r")).alias("c")).collect()] == ["enroll", "probe"]
    with pytest.raises(Exception, match="unknown role"):
        spark.createDataFrame([("judge",)], "r string").select(filters.canonical_role(F.col("r"))).collect()


def test_same_visit_copies_stay(spark):
    rows = spark.createDataFrame([("s", 1, "x", 1), ("s", 1, "x", 2), ("s", 2, "x", 3), ("s", 2, "y", 4)], "subject string, visit int, text string, id int")
    kept = filters.first_visit_content(rows, "subject", "visit", F.col("text"))
    assert {r["id"] for r in kept.collect()} == {1, 2, 4}


# --- ranges ----------------------------------------------------------------------------------------


def ranges(spark, spans):
    return spark.createDataFrame([("k", float(a), float(b)) for a, b in spans], "key string, start_min double, end_min double")


def spans_of(df):
    return sorted((r["start_min"], r["end_min"]) for r in df.collect())


def test_range_algebra(spark):
    a = intervals.coalesce_ranges(ranges(spark, [(0, 5), (5, 10), (20, 4000), (25, 30), (5000, 5001)]), ["key"])
    assert spans_of(a) == [(0.0, 10.0), (20.0, 4000.0), (5000.0, 5001.0)]
    b = intervals.coalesce_ranges(ranges(spark, [(10, 21), (3999, 4990)]), ["key"])
    assert spans_of(intervals.intersect_ranges(a, b, ["key"])) == [(20.0, 21.0), (3999.0, 4000.0)]
    gap = lambda x, y: intervals.range_separation(x, y, ["key"]).first()["gap_min"]
    assert gap(a, b) == 0.0
    assert gap(ranges(spark, [(0, 5)]), ranges(spark, [(5, 6)])) == 0.0
    assert gap(ranges(spark, [(100, 110)]), ranges(spark, [(0, 40), (2000, 2001)])) == 60.0
    assert gap(ranges(spark, [(1, 2)]), ranges(spark, []).where("false")) is None


def test_invalid_ranges(spark):
    bad = intervals.invalid_ranges(ranges(spark, [(0, 1), (-1, 1), (3, 3), (0, math.inf)]))
    assert sorted(r["reason"] for r in bad.collect()) == ["empty", "negative start", "not finite"]


# --- signals ---------------------------------------------------------------------------------------


def test_windows_over_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(signal, "CHUNK", 7)
    monkeypatch.setattr(signal, "BIN", 5)
    values = [float((i * 37) % 11) for i in range(40)]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "record string, idx long, value double")
    got = [r["value"] for r in signal.moving_average(df, ["record"], 5).orderBy("idx").collect()]
    padded = [0.0] * 2 + values + [0.0] * 2
    assert got == pytest.approx([sum(padded[i: i + 5]) / 5 for i in range(40)])
    middle = [r["value"] for r in signal.median_filter(df, ["record"], 4).orderBy("idx").collect()]
    assert middle == [sorted(padded[i: i + 5])[2] for i in range(40)]
    cubic = df.withColumn("value", 2 + 3 * F.col("idx") - 0.1 * F.col("idx") ** 2 + 0.01 * F.col("idx") ** 3)
    flat = [r["value"] for r in signal.remove_polynomial(cubic, ["record"], 3).collect()]
    assert flat == pytest.approx([0.0] * 40, abs=1e-8)
    windows = signal.blind_windows(df, ["record"], 6, 4).collect()
    assert {r["window_no"]: r["beat"] for r in windows} == {k: values[4 * k: 4 * k + 6] for k in range(9)}


def pulses(spark, inverted):
    sign = -1.0 if inverted else 1.0
    centres = [50, 130, 210, 290]
    wave = lambda i: sum(sign * math.exp(-((i - c) ** 2) / 8) - sign * 0.3 * math.exp(-((i - c - 8) ** 2) / 18) for c in centres)
    return centres, spark.createDataFrame([("r", i, wave(i)) for i in range(340)], "record string, idx long, value double")


@pytest.mark.parametrize("inverted", [False, True])
def test_beats_follow_the_peak(spark, inverted):
    centres, df = pulses(spark, inverted)
    guesses = spark.createDataFrame([("r", c + 2) for c in centres] + [("r", centres[0] - 1), ("r", 339)], "record string, peak long")
    assert signal.peak_polarity(guesses, df, ["record"], 20).first()["polarity"] == (-1 if inverted else 1)
    refined = signal.refine_peaks(guesses.where("peak < 339"), df, ["record"], 20)
    assert sorted(r["peak"] for r in refined.collect()) == centres
    beats = signal.cut_beats(refined, df, ["record"], 51, 10).collect()
    assert sorted(r["peak"] for r in beats) == centres[1:]  # the first window leaves the recording


def test_detected_peaks_and_rate(spark):
    centres, df = pulses(spark, False)
    found = signal.detect_peaks(df, ["record"], 1.0, 10)
    assert sorted(r["peak"] for r in found.collect()) == centres
    every = spark.createDataFrame([("r", 200 * i) for i in range(6)] + [("s", 0), ("s", 9)], "record string, peak long")
    rates = {r["record"]: r["bpm"] for r in signal.heart_rates(every, ["record"], 250.0).collect()}
    assert rates == {"r": 75.0, "s": None}


def test_resampling_round_trip(spark):
    wave = [math.sin(2 * math.pi * i / 16) + 0.5 for i in range(16)]
    df = spark.createDataFrame([(wave,)], "beat array<double>")
    longer = df.select(signal.resampled(F.col("beat"), 32).alias("beat"))
    assert longer.first()["beat"] == pytest.approx([math.sin(2 * math.pi * i / 32) + 0.5 for i in range(32)])
    assert longer.select(signal.resampled(F.col("beat"), 16).alias("b")).first()["b"] == pytest.approx(wave)


def test_half_to_even(spark):
    out = spark.range(1).select(
        signal.alignment_half_width(F.lit(250.0), F.lit(0.01)).alias("a"), signal.alignment_half_width(F.lit(10.0), F.lit(0.01)).alias("b")
    ).first()
    assert tuple(out) == (2, 1)


def test_flat_segment_is_unchanged(spark):
    df = spark.createDataFrame([([2.0, 2.0],)], "beat array<double>")
    out = df.select(signal.normalised(F.col("beat")).alias("a"), signal.kurtosis_quality(F.col("beat")).alias("q")).first()
    assert out["a"] == [2.0, 2.0] and out["q"] == 0.0


def test_outlier_filter(spark):
    rows = list(zip("AAABBB", [0.2, 0.9, 0.8, 0.7, 0.1, 0.6], range(6)))
    df = spark.createDataFrame(rows, "y string, q double, id long")
    assert {r["id"] for r in signal.outlier_filter(df, ["y"], "q", "id", 0.5).collect()} == {1, 2, 3, 5}
    assert {r["id"] for r in signal.outlier_filter(df, ["y"], "q", "id", 0.5, 0.5).collect()} == {1, 3}


# --- statistics ------------------------------------------------------------------------------------


def test_distribution_functions(spark):
    assert stats.t_quantile(0.95, 4) == pytest.approx(2.7764451051977987)
    assert stats.t_quantile(0.95, 1) == pytest.approx(12.706204736432095)
    cases = [(2.0, 1), (2.0, 2), (2.0, 7), (2.0, 10), (2.0, 5000), (0.0, 3)]
    wanted = [0.2951672353, 0.1835034191, 0.0856193286, 0.0733880348, 0.0455533, 1.0]
    df = spark.createDataFrame(cases, "t double, df long")
    got = [r["p"] for r in df.select(stats.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()]
    assert got == pytest.approx(wanted, abs=1e-6)
    z = spark.range(1).select(stats.normal_two_sided(F.lit(1.959963984540054)).alias("p")).first()["p"]
    assert z == pytest.approx(0.05)


def paired(spark, differences):
    rows = [("m", s, 0.0, float(d)) for s, d in enumerate(differences)]
    return spark.createDataFrame(rows, "metric string, seed int, reference double, comparison double")


def test_degenerate_pairs(spark):
    same = inference.t_test(inference.effect_size(inference.difference_profile(paired(spark, [0, 0, 0]), ["metric"]))).first()
    assert (same["dz"], same["t"], same["p"]) == (0.0, 0.0, 1.0)
    shift = inference.t_test(inference.effect_size(inference.difference_profile(paired(spark, [-2, -2, -2]), ["metric"]))).first()
    assert (shift["dz"], shift["t"], shift["p"]) == (-math.inf, -math.inf, 0.0)
    one = inference.t_test(inference.difference_profile(paired(spark, [1]), ["metric"])).first()
    assert one["t"] is None and one["p"] is None


def test_signed_ranks(spark):
    p = lambda d: inference.signed_rank_test(paired(spark, d), ["metric"]).first()["p"]
    assert p([1, 2, 3, 4, 5]) == pytest.approx(0.0625)
    assert p([1, -2, 3, 4, 5, 6]) == pytest.approx(6 / 64)  # sums 0, 1 and 2
    assert p([0, 0, 0]) == 1.0
    # ties: normal approximation with correction, w = 2.5
    assert p([1, 2, -2, 3, 4]) == pytest.approx(math.erfc(abs((2.5 - 7.5) / math.sqrt(5 * 6 * 11 / 24 - 6 / 48)) / math.sqrt(2)))


def test_holm(spark):
    rows = [(1, "f", 0.01), (2, "f", 0.04), (3, "f", 0.03), (4, "f", None), (5, "g", 0.04)]
    out = inference.holm(spark.createDataFrame(rows, "id int, family string, p double"), ["family"], "p", ["id"])
    got = {r["id"]: (r["adjusted_p"], r["reject"]) for r in out.collect()}
    assert got[1] == (pytest.approx(0.03), True) and got[2] == (pytest.approx(0.06), False) and got[3] == (pytest.approx(0.06), False)
    assert got[4] == (None, None) and got[5] == (pytest.approx(0.04), True)


def test_one_missing_run_makes_null(spark):
    rows = [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 1.0), ("b", 2, None), ("c", 1, 1.0), ("c", 2, math.nan), ("d", 1, 4.0)]
    runs = spark.createDataFrame(rows, "metric string, seed int, value double")
    got = {r["metric"]: (r["mean"], r["std"]) for r in inference.aggregate_runs(runs, ["metric"]).collect()}
    assert got == {"a": (2.0, 1.0), "b": (None, None), "c": (None, None), "d": (4.0, 0.0)}
    widths = {r["metric"]: r["lower"] for r in inference.uncertainty(runs, ["metric"]).collect()}
    assert set(widths) == {"a", "d"} and widths["d"] is None
    mean, std = inference.parse_run_text(F.lit("0.5 ± 0.25"))
    row = spark.range(1).select(mean.alias("m"), std.alias("s"), inference.parse_run_text(F.lit("n/a"))[0].alias("x")).first()
    assert tuple(row) == (0.5, 0.25, None)


def test_joint_model(spark):
    rows = [(i, float(3 + 2 * a - b), float(a), float(b), 7.0) for i, (a, b) in enumerate([(0, 1), (1, 0), (2, 5), (3, 1), (4, 2), (7, 7)])]
    cases = spark.createDataFrame(rows, "id int, outcome double, a double, b double, flat double")
    fit = {r["covariate"]: r for r in covariates.joint_model(cases, ["a", "b", "flat"]).collect()}
    assert set(fit) == {"a", "b"} and fit["a"]["r_squared"] == pytest.approx(1.0)
    assert fit["a"]["vif"] == pytest.approx(fit["b"]["vif"])
    flagged = {r["covariate"]: (r["constant"], r["pearson"]) for r in covariates.univariate(cases, ["a", "flat"]).collect()}
    assert flagged["flat"] == (True, None) and flagged["a"][0] is False


def test_incomplete_series(spark):
    runs = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.0), ("c", 1, 1.0), ("c", 2, None)], "s string, seed int, value double")
    assert [r["s"] for r in tables.complete_series(runs, ["s"], 2).collect()] == ["a"]


# --- sources, sinks, streams -----------------------------------------------------------------------


def test_text_recordings(spark, tmp_path):
    folder = tmp_path / "Session-1" / "s7"
    folder.mkdir(parents=True)
    (folder / "rec.txt").write_text("# head\n1.5\n\n2.5\n# note\n3.5\n")
    (folder / "._rec.txt").write_text("9\n")
    got = readers.session_folders(spark, str(tmp_path), first_samples=2).orderBy("sample_idx").collect()
    assert [tuple(r) for r in got] == [("Session-1", "s7", 0, 1.5), ("Session-1", "s7", 1, 2.5)]


def test_named_recordings(spark, tmp_path):
    good = tmp_path / "20200131-x1-S2-A"
    good.mkdir()
    (good / "r.txt").write_text("5,6\n7\n")
    rows = readers.named_recordings(spark, str(tmp_path), 1).orderBy("sample_idx").collect()
    assert [tuple(r) for r in rows] == [(D(2020, 1, 31), "x1", "S2", "A", 0, 6.0), (D(2020, 1, 31), "x1", "S2", "A", 1, 7.0)]
    bad = tmp_path / "2020xx31-x1-S2-A"
    bad.mkdir()
    (bad / "r.txt").write_text("5\n")
    with pytest.raises(Exception, match="no date in name"):
        readers.named_recordings(spark, str(tmp_path), 1).collect()


def test_json_rejects_nan(spark, tmp_path):
    path = str(tmp_path / "records")
    sinks.append_json(spark.createDataFrame([("e", 1.0), ("f", None)], "experiment string, v double"), path)
    with pytest.raises(Exception, match="NaN"):
        sinks.append_json(spark.createDataFrame([("e", math.nan)], "experiment string, v double"), path)
    assert spark.read.json(path).count() == 2
    records = spark.read.json(path)
    assert readers.pick_record(records, {"experiment": "e"}).count() == 1
    with pytest.raises(ValueError, match="no record"):
        readers.pick_record(records, {"experiment": "z"})


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    turned = df.orderBy(F.desc("i")).select("s", "i")
    assert sinks.fingerprint(df).collect() == sinks.fingerprint(turned).collect()
    other = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    assert sinks.fingerprint(df).collect() != sinks.fingerprint(other).collect()


def test_groups_continue_over_files(spark, tmp_path):
    source = tmp_path / "in"
    schema = "event_id long, ts timestamp_ntz, user_id long, value double"
    for part in range(2):
        rows = [(5 * part + i, dt.datetime(2024, 1, 1, part, i), i % 2, 1.0) for i in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = streams.event_stream(spark, str(source), "*.parquet", spark.read.parquet(str(source)).schema)
    out = streams.run_to_table(streams.groups_of(stream, ["user_id"], "event_id", 2), "test-groups").collect()
    counts = {0: 0, 1: 0}
    for row in out:
        counts[row["user_id"]] += 1
        assert len(row["members"]) == 2
    assert counts == {0: 3, 1: 2}  # six and four rows, three of user 0 in each file
    members = [m for row in out for m in row["members"]]
    assert len(members) == len(set(members))


@pytest.mark.parametrize("start", [0, 101, 1024])
def test_segments_count_from_their_own_start(spark, start):
    """A segment read from the middle of a recording is filtered and cut like one that begins at 0."""
    values = [float((7 * k) % 11) for k in range(40)]

    def at(first):
        return spark.createDataFrame([("a", first + k, v) for k, v in enumerate(values)], "record string, idx bigint, value double")

    def shifted(df, first):
        return sorted((r["idx"] - first, round(r["value"], 9)) for r in df.collect())

    here, there = at(0), at(start)
    for step in (lambda s: signal.median_filter(s, ["record"], 5), lambda s: signal.remove_polynomial(s, ["record"], 5)):
        assert shifted(step(there), start) == shifted(step(here), 0)
    cut = lambda s: sorted((r["window_no"], r["beat"]) for r in signal.blind_windows(s, ["record"], 10, 7).collect())
    assert cut(there) == cut(here) and len(cut(here)) == 5


def test_polynomial_of_any_order_is_removed(spark):
    rows = [("a", k, 2.0 + k - 0.3 * k**2 + 0.01 * k**5) for k in range(50, 80)]
    df = spark.createDataFrame(rows, "record string, idx bigint, value double")
    assert max(abs(r["value"]) for r in signal.remove_polynomial(df, ["record"], 5).collect()) < 1e-3


def test_source_order_uses_the_time_of_day(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, k, day.replace(hour=h), 10 - k, str(k), "s", 0.0, k, k) for k, h in enumerate((18, 8, 12))]
    df = spark.createDataFrame(
        rows,
        "subject int, obs_id int, acquisition_time timestamp, acquisition_order int, record_id string, source_segment_id string, "
        "source_segment_order double, beat_ordinal int, rpeak_index int",
    )
    got = {r["obs_id"]: r["source_no"] for r in fusion.source_order(df, ["subject"]).collect()}
    assert got == {1: 1, 2: 2, 0: 3}


def test_impossible_split_is_refused(spark):
    df = spark.createDataFrame([(k, k // 3) for k in range(25)], "id int, label int")
    with pytest.raises(Exception, match="both sides"):
        splits.stratified_split(df, "label", "id", 0.1, 1).collect()


def test_small_p_values_keep_their_digits(spark):
    df = spark.createDataFrame([(20.0, 100, 9.0), (1.0, 1, 30.0), (2.0, 10, 0.5)], "t double, df int, z double")
    rows = df.select(stats.t_two_sided(F.col("t"), F.col("df")), stats.normal_two_sided(F.col("z"))).collect()
    wanted = [(9.9942678613e-37, math.erfc(9 / math.sqrt(2))), (0.5, math.erfc(30 / math.sqrt(2))), (0.0733880348, math.erfc(0.5 / math.sqrt(2)))]
    for row, (t, z) in zip(rows, wanted):
        assert math.isclose(row[0], t, rel_tol=1e-8) and math.isclose(row[1], z, rel_tol=1e-8)


def test_equal_order_values_enroll_one_record(spark):
    rows = "('s', 'a', DATE '2020-01-01', 1L), ('s', 'b', DATE '2020-01-01', 1L), ('s', 'c', DATE '2020-01-01', 2L), ('s', 'd', DATE '2020-01-01', 2L)"
    records = spark.sql(f"SELECT * FROM VALUES {rows} t(subject, record, date, turn)")
    roles_of = lambda regime: {r["record"]: r["role"] for r in regime(records, "subject", "date", ["turn", "record"]).collect()}
    assert roles_of(roles.single_shot_short_term) == {"a": "enroll", "b": "probe", "c": "probe", "d": "probe"}
    assert roles_of(roles.leave_last_out_short_term) == {"a": "enroll", "b": "enroll", "c": "enroll", "d": "probe"}


def line_with_gap(spark):
    indices = [*range(10), *range(20, 30)]
    return spark.createDataFrame([("r", k, 2.0 * k + 1) for k in indices], "record string, idx long, value double")


def test_gap_stops_the_polynomial(spark):
    df = line_with_gap(spark)
    with pytest.raises(Exception, match="missing or repeated indices"):
        signal.remove_polynomial(df, ["record"], 1).collect()
    with pytest.raises(Exception, match="missing or repeated indices"):
        signal.median_filter(df, ["record"], 5).collect()
    parts = df.withColumn("record", F.concat("record", (F.col("idx") >= 20).cast("string")))  # its parts are segments
    assert all(abs(r["value"]) < 1e-9 for r in signal.remove_polynomial(parts, ["record"], 1).collect())


def test_average_counts_indices_not_rows(spark):
    df = line_with_gap(spark)
    got = {r["idx"]: r["value"] for r in signal.moving_average(df, ["record"], 5).collect()}
    value = {r["idx"]: r["value"] for r in df.collect()}
    assert got == pytest.approx({k: sum(value.get(j, 0.0) for j in range(k - 2, k + 3)) / 5 for k in value})
    inner = {r["idx"] for r in signal.convolve(df, ["record"], [0.2] * 5, interior=True).collect()}
    assert inner == {*range(2, 8), *range(22, 28)}


def waves(spark, n=500):
    rows = [("a", k + 7, math.sin(k / 9) + (k % 13) / 10) for k in range(n)] + [("b", k, float(k * k % 11)) for k in range(37)]
    return spark.createDataFrame(rows, "record string, idx long, value double").repartition(3), rows


@pytest.mark.parametrize("width, hop, run", [(16, 4, 64), (15, 7, 21), (8, 20, 40), (30, 30, 65536)])
def test_spectra_equal_a_direct_transform(spark, monkeypatch, width, hop, run):
    monkeypatch.setattr(encodings, "CHUNK_SAMPLES", run)  # several runs of frames
    df, rows = waves(spark)
    got = {(r["record"], r["frame"], r["bin"]): r["power"] for r in encodings.stft(df, ["record"], width, hop, False).collect()}
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    wanted = {}
    for record, start in (("a", 7), ("b", 0)):
        value = {k - start: v for name, k, v in rows if name == record}
        for frame in range(-(-len(value) // hop) + 1):
            places = [frame * hop - width // 2 + i for i in range(width)]
            if any(p in value for p in places):
                x = np.array([value.get(p, 0.0) for p in places]) * window
                power = np.abs(np.fft.fft(x)[: width // 2 + 1]) ** 2 / window.sum() ** 2
                wanted |= {(record, frame, k): p for k, p in enumerate(power)}
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)


@pytest.mark.parametrize("n_taps", [5, 101])
@pytest.mark.parametrize("interior", [False, True])
def test_convolution_over_chunks(spark, monkeypatch, n_taps, interior):
    monkeypatch.setattr(signal, "CHUNK", 128)
    df, rows = waves(spark)
    taps = [math.cos(k) / n_taps for k in range(n_taps)]
    half = n_taps // 2
    wanted = {}
    for record in "ab":
        value = {k: v for name, k, v in rows if name == record}
        for k in value:
            near = [value.get(k + d - half) for d in range(n_taps)]
            if not interior or None not in near:
                wanted[record, k] = sum(t * (v or 0.0) for t, v in zip(taps, near))
    found = signal.convolve(df.withColumn("note", F.col("idx") * 2), ["record"], taps, interior).collect()
    assert all(r["note"] == 2 * r["idx"] for r in found)
    got = {(r["record"], r["idx"]): r["value"] for r in found}
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)


@pytest.mark.parametrize("length", [5, 8, 13, 29])
def test_resampling_of_mixed_sizes(spark, length):
    rng = np.random.default_rng(2)
    beats = [rng.normal(size=n).tolist() for n in (7, 8, 13, 29, 8)] + [None]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(beats)], "k int, beat array<double>")
    got = {r["k"]: r["b"] for r in df.select("k", signal.resampled(F.col("beat"), length).alias("b")).collect()}
    assert got[5] is None
    for k, beat in enumerate(beats[:5]):
        n, spectrum = len(beat), np.fft.fft(beat)
        wanted = []
        for j in range(length):  # each frequency at its place, the middle one of an even count halved on both sides
            total, shared = 0.0, min(n, length)
            for f in range(-(shared // 2), shared // 2 + 1):
                weight = 0.5 if shared % 2 == 0 and abs(f) == shared // 2 and n <= length else 1.0
                if n > length and shared % 2 == 0 and abs(f) == shared // 2:
                    total += (spectrum[f % n].real if f > 0 else spectrum[f % n].real) * math.cos(math.pi * j)
                else:
                    total += (weight * spectrum[f % n] * np.exp(2j * np.pi * f * j / length)).real
            wanted.append(total / n)
        assert got[k] == pytest.approx(beat if n == length else wanted, abs=1e-9)


def test_recurrence_modes(spark):
    beat = [0.0, 1.0, 3.0, 1.5, 0.2, 2.0]
    df = spark.createDataFrame([("a", beat), ("short", [1.0])], "k string, beat array<double>")
    points = list(zip(beat, beat[1:]))
    distance = np.array([[math.dist(p, q) for q in points] for p in points])
    plots = {
        ("point", 30.0): distance < np.percentile(distance, 30),
        ("distance", 40.0): distance < 0.4 * distance.max(),
        (1.2, 10.0): distance <= 1.2,
        (None, 10.0): distance,
    }
    for (mode, share), wanted in plots.items():
        rows = encodings.recurrence_plot(df, ["k"], 2, 1, mode, share).collect()
        assert {r["k"] for r in rows} == {"a"}
        got = {(r["i"], r["j"]): r["value"] for r in rows}
        assert got == pytest.approx({(i, j): float(wanted[i, j]) for i in range(5) for j in range(5)})
    with pytest.raises(ValueError):
        encodings.recurrence_plot(df, ["k"], threshold="area")


def test_holm_makes_each_p_value_once(spark):
    """P-values are costly: the steps of the adjustment read them, they do not make them again."""
    made = spark.sparkContext.accumulator(0)

    def p_value(k):
        made.add(1)
        return (k % 37) / 40

    tests = spark.range(100).select("id", (F.col("id") % 3).alias("family"), F.udf(p_value, "double")("id").alias("p"))
    out = inference.holm(tests, ["family"], "p", ["id"]).collect()
    assert len(out) == 100 and made.value == 100
