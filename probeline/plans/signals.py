"""Signal work on ``events`` as long recordings, segment work on windows, augmentation on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from probeline.functions.columns import rounded
from probeline.functions.ordering import numbered
from probeline.operators import augment, encodings, signal
from probeline.plans import matching
from probeline.plans.fixtures import samples
from probeline.plans.registry import cte, query, r, table, with_ctes
from probeline.session import cut_lineage

KEYS = ["record"]
RATE = 50.0
W, STRIDE = 8, 8


def _long(beats, *keys):
    """Segments to one row per position."""
    out = beats.select(*keys, F.posexplode("beat").alias("pos", "value"))
    return out.withColumn("value", rounded("value")).withColumn("pos", F.col("pos").cast("bigint"))


def _plain(df):
    return df.select("record", "idx", rounded("value").alias("value"))


def windows_in_sql(source: str, keys: str, width: int, stride: int) -> str:
    return (
        f"SELECT {keys}, window_no, list(value ORDER BY idx) AS beat FROM (SELECT *, unnest(range(greatest(0, "
        f"ceil((idx - {width - 1}) / {stride})::BIGINT), idx // {stride} + 1)) AS window_no FROM {source}) "
        f"GROUP BY {keys}, window_no HAVING count(*) = {width}"
    )


cte("bw", windows_in_sql("sp", "record", W, STRIDE), ("sp",))
cte("ow", windows_in_sql("sp", "record", 8, 3), ("sp",))


@query(
    "g01_moving_average",
    with_ctes(
        "sp",
        f"SELECT record, idx, {r('sum(value) OVER (PARTITION BY record ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5')} "
        "AS value FROM sp",
    ),
)
def moving_average(spark, sf_dir):
    return _plain(signal.moving_average(samples(spark, sf_dir), KEYS, 5))


@query(
    "g01_moving_average_even",
    with_ctes(
        "sp",
        f"SELECT record, idx, {r('sum(value) OVER (PARTITION BY record ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4')} "
        "AS value FROM sp",
    ),
)
def moving_average_even(spark, sf_dir):
    return _plain(signal.moving_average(samples(spark, sf_dir), KEYS, 4))


@query(
    "g02_median_filter",
    with_ctes(
        "sp",
        f"SELECT record, idx, {r('list_sort(list_concat(l, list_resize([]::DOUBLE[], 5 - len(l), 0.0)))[3]')} AS value FROM "
        "(SELECT record, idx, list(value) OVER (PARTITION BY record ORDER BY idx ROWS BETWEEN 2 PRECEDING AND "
        "2 FOLLOWING) AS l FROM sp)",
    ),
)
def median_filter(spark, sf_dir):
    return _plain(signal.median_filter(samples(spark, sf_dir), KEYS, 5))


def convolution_in_sql(taps: list[float], interior: bool) -> str:
    half = len(taps) // 2
    listed = "[" + ", ".join(repr(t) for t in taps) + "]::DOUBLE[]"
    having = f" HAVING count(*) = {len(taps)}" if interior else ""
    return (
        f"SELECT record, idx, {r('s')} AS value FROM (SELECT a.record, a.idx, sum(b.value * t.w[b.idx - a.idx + {half + 1}]) "
        f"AS s FROM sp a JOIN sp b ON a.record = b.record AND b.idx BETWEEN a.idx - {half} AND a.idx + {half} CROSS JOIN "
        f"(SELECT {listed} AS w) t GROUP BY a.record, a.idx{having})"
    )


@query("g03_savgol", with_ctes("sp", convolution_in_sql(signal.savgol_taps(11, 2), True)))
def savgol(spark, sf_dir):
    return _plain(signal.convolve(samples(spark, sf_dir), KEYS, signal.savgol_taps(11, 2), interior=True))


_BAND = signal.bandpass_taps(RATE, 2.0, 15.0, 31)


@query("g04_fir_bandpass", with_ctes("sp", convolution_in_sql(_BAND, False)))
def fir_bandpass(spark, sf_dir):
    return _plain(signal.convolve(samples(spark, sf_dir), KEYS, _BAND))


@query(
    "g05_linear_baseline",
    with_ctes(
        "sp",
        f"SELECT s.record, s.idx, {r('s.value - (f.a + f.b * s.idx)')} AS value FROM sp s JOIN (SELECT record, "
        "regr_intercept(value, idx) AS a, regr_slope(value, idx) AS b FROM sp GROUP BY record) f USING (record)",
    ),
)
def linear_baseline(spark, sf_dir):
    return _plain(signal.remove_polynomial(samples(spark, sf_dir), KEYS, 1))


@query(
    "g05_cubic_baseline",
    with_ctes(
        "sp",
        "SELECT record, idx, "
        + r("value - (avg(value) OVER w + sum(value * p1) OVER w / sum(p1 * p1) OVER w * p1 + sum(value * p2) OVER w / "
            "sum(p2 * p2) OVER w * p2 + sum(value * p3) OVER w / sum(p3 * p3) OVER w * p3)")
        + " AS value FROM (SELECT *, u AS p1, u * u - (n * n - 1) / 12 AS p2, u * u * u - u * (3 * n * n - 7) / 20 AS p3 "
        "FROM (SELECT *, idx - (n - 1) / 2 AS u FROM (SELECT *, (count(*) OVER (PARTITION BY record))::DOUBLE AS n FROM sp))) "
        "WINDOW w AS (PARTITION BY record)",
    ),
)
def cubic_baseline(spark, sf_dir):
    return _plain(signal.remove_polynomial(samples(spark, sf_dir), KEYS, 3))


# --- peaks and beats -------------------------------------------------------------------------------

DEVIATIONS, REFRACTORY, HALF, PRE, POST = 1.0, 5, 2, 3, 5


def peaks_in_sql(source: str, keys: str, deviations: float, refractory: int) -> str:
    return (
        f"SELECT {keys}, arg_max(idx, (value, -idx)) AS peak FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY idx) "
        f"AS run FROM (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY {keys} ORDER BY idx) <= {refractory} THEN 0 ELSE 1 "
        f"END AS fresh FROM (SELECT *, lag(value) OVER (PARTITION BY {keys} ORDER BY idx) AS before, lead(value) OVER "
        f"(PARTITION BY {keys} ORDER BY idx) AS after, avg(value) OVER (PARTITION BY {keys}) + {deviations} * stddev_pop(value) "
        f"OVER (PARTITION BY {keys}) AS level FROM {source}) WHERE value > before AND value >= after AND value > level)) "
        f"GROUP BY {keys}, run"
    )


def polarity_in_sql(peaks: str, source: str) -> str:
    return (
        "SELECT record, sum(top - mid) AS up, sum(mid - bottom) AS down, CASE WHEN sum(mid - bottom) > sum(top - mid) THEN -1 "
        f"ELSE 1 END AS polarity FROM (SELECT p.record, p.peak, max(value) AS top, min(value) AS bottom, median(value) AS mid "
        f"FROM {peaks} p JOIN {source} s ON s.record = p.record AND s.idx BETWEEN p.peak - {HALF} AND p.peak + {HALF} "
        "GROUP BY p.record, p.peak HAVING count(*) >= 2) GROUP BY record"
    )


def refined_in_sql(peaks: str, polarity: str, source: str) -> str:
    return (
        "SELECT DISTINCT record, peak FROM (SELECT p.record, arg_max(s.idx, (q.polarity * s.value, -s.idx)) AS peak FROM "
        f"{peaks} p JOIN {polarity} q ON q.record = p.record JOIN {source} s ON s.record = p.record AND s.idx BETWEEN "
        f"p.peak - {HALF} AND p.peak + {HALF} GROUP BY p.record, p.peak)"
    )


def beats_in_sql(peaks: str, source: str) -> str:
    return (
        f"SELECT p.record, p.peak, list(value ORDER BY idx) AS beat FROM {peaks} p JOIN {source} s ON s.record = p.record "
        f"AND s.idx BETWEEN p.peak - {PRE} AND p.peak + {POST - 1} GROUP BY p.record, p.peak HAVING count(*) = {PRE + POST}"
    )


def zscore_in_sql(beat: str = "beat") -> str:
    return (
        f"CASE WHEN list_aggregate({beat}, 'stddev_pop') < 1e-6 THEN {beat} ELSE list_transform({beat}, lambda x: "
        f"(x - list_avg({beat})) / list_aggregate({beat}, 'stddev_pop')) END"
    )


def long_in_sql(source: str, keys: str, beat: str = "beat") -> str:
    return (
        f"SELECT {keys}, pos, {r('value')} AS value FROM (SELECT {keys}, unnest({beat}) AS value, "
        f"generate_subscripts({beat}, 1) - 1 AS pos FROM {source})"
    )


cte("pk", peaks_in_sql("sp", "record", DEVIATIONS, REFRACTORY), ("sp",))
cte("pp", polarity_in_sql("pk", "sp"), ("pk", "sp"))
cte("rp", refined_in_sql("pk", "pp", "sp"), ("pk", "pp", "sp"))
cte("cb", beats_in_sql("rp", "sp"), ("rp", "sp"))


def _samples_and_peaks(spark, sf_dir):
    stored = cut_lineage(samples(spark, sf_dir))
    return stored, signal.detect_peaks(stored, KEYS, DEVIATIONS, REFRACTORY)


@query("g06_peaks", with_ctes("pk", "SELECT record, peak FROM pk"))
def peaks(spark, sf_dir):
    return _samples_and_peaks(spark, sf_dir)[1]


@query(
    "g07_alignment_half_width",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(1, round_even(l_quantity * l_discount, 0)::INT) AS half "
    "FROM lineitem",
)
def alignment_half_width(spark, sf_dir):
    """Quantity as the sampling rate, discount as seconds."""
    lines = table(spark, sf_dir, "lineitem")
    half = signal.alignment_half_width(F.col("l_quantity"), F.col("l_discount"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", half.alias("half"))


@query(
    "g08_peak_polarity",
    with_ctes("pp", f"SELECT record, {r('up')} AS up, {r('down')} AS down, polarity FROM pp"),
)
def peak_polarity(spark, sf_dir):
    stored, found = _samples_and_peaks(spark, sf_dir)
    out = signal.peak_polarity(found, stored, KEYS, HALF)
    return out.withColumn("up", rounded("up")).withColumn("down", rounded("down"))


@query("g09_refined_peaks", with_ctes("rp", "SELECT record, peak FROM rp"))
def refined_peaks(spark, sf_dir):
    stored, found = _samples_and_peaks(spark, sf_dir)
    return signal.refine_peaks(found, stored, KEYS, HALF)


@query("g10_beats", with_ctes("cb", long_in_sql("cb", "record, peak")))
def beats(spark, sf_dir):
    stored, found = _samples_and_peaks(spark, sf_dir)
    refined = signal.refine_peaks(found, stored, KEYS, HALF)
    return _long(signal.cut_beats(refined, stored, KEYS, PRE, POST), "record", "peak")


@query(
    "g11_blind_windows",
    with_ctes("ow", long_in_sql("ow", "record, window_no")),
)
def blind_windows(spark, sf_dir):
    return _long(signal.blind_windows(samples(spark, sf_dir), KEYS, 8, 3), "record", "window_no")


def _windows(spark, sf_dir):
    return signal.blind_windows(samples(spark, sf_dir), KEYS, W, STRIDE)


@query("g12_zscore", with_ctes("bw", long_in_sql(f"(SELECT record, window_no, {zscore_in_sql()} AS beat FROM bw)", "record, window_no")))
def zscore(spark, sf_dir):
    out = _windows(spark, sf_dir).withColumn("beat", signal.normalised(F.col("beat"), "zscore"))
    return _long(out, "record", "window_no")


@query(
    "g12_minmax",
    with_ctes(
        "bw",
        long_in_sql(
            "(SELECT record, window_no, CASE WHEN list_max(beat) - list_min(beat) < 1e-6 THEN beat ELSE "
            "list_transform(beat, lambda x: (x - list_min(beat)) / (list_max(beat) - list_min(beat))) END AS beat FROM bw)",
            "record, window_no",
        ),
    ),
)
def minmax(spark, sf_dir):
    out = _windows(spark, sf_dir).withColumn("beat", signal.normalised(F.col("beat"), "minmax"))
    return _long(out, "record", "window_no")


def fourier_in_sql(source: str, keys: str, n: int, length: int) -> str:
    """Resampling as one weight per input and output position."""
    shared = min(n, length)
    weight = "1.0" + "".join(
        f" + 2 * cos(2 * pi() * {k} * (j / {length}.0::DOUBLE - i / {n}.0::DOUBLE))" for k in range(1, (shared - 1) // 2 + 1)
    )
    if shared % 2 == 0:
        half = shared // 2
        if length < n:
            weight += f" + 2 * cos(2 * pi() * {half} * i / {n}.0::DOUBLE) * cos(2 * pi() * {half} * j / {length}.0::DOUBLE)"
        else:
            weight += f" + cos(2 * pi() * {half} * (j / {length}.0::DOUBLE - i / {n}.0::DOUBLE))"
    return (
        f"SELECT {keys}, j AS pos, sum(x * ({weight})) / {n} AS value FROM (SELECT {keys}, unnest(beat) AS x, "
        f"generate_subscripts(beat, 1) - 1 AS i FROM {source}) CROSS JOIN (SELECT unnest(range({length})) AS j) GROUP BY {keys}, j"
    )


def _resampling(name: str, length: int):
    sql = with_ctes(
        "bw",
        f"SELECT record, window_no, pos, {r('value')} AS value FROM ({fourier_in_sql('bw', 'record, window_no', W, length)})",
    )

    @query(name, sql)
    def resample(spark, sf_dir):
        out = _windows(spark, sf_dir).withColumn("beat", signal.resampled(F.col("beat"), length))
        return _long(out, "record", "window_no")


_resampling("g13_resample_longer", 13)
_resampling("g13_resample_shorter", 6)


@query(
    "g13_resample_linear",
    with_ctes(
        "bw",
        long_in_sql(
            "(SELECT record, window_no, list_transform(range(13), lambda j: beat[floor(j * 7 / 12.0::DOUBLE)::INT + 1] * (1 - (j * 7 "
            "/ 12.0::DOUBLE - floor(j * 7 / 12.0::DOUBLE))) + beat[least(floor(j * 7 / 12.0::DOUBLE)::INT + 2, 8)] * (j * 7 / 12.0::DOUBLE "
            "- floor(j * 7 / 12.0::DOUBLE))) AS beat FROM bw)",
            "record, window_no",
        ),
    ),
)
def resample_linear(spark, sf_dir):
    out = _windows(spark, sf_dir).withColumn("beat", signal.resampled(F.col("beat"), 13, "linear"))
    return _long(out, "record", "window_no")


MERGE, MERGE_STRIDE = 3, 2
_RUNS = (
    f"(SELECT record, merge_no, list(beat ORDER BY window_no) AS run FROM (SELECT *, unnest(range(greatest(0, ceil((window_no - "
    f"{MERGE - 1}) / {MERGE_STRIDE})::BIGINT), window_no // {MERGE_STRIDE} + 1)) AS merge_no FROM bw) GROUP BY record, merge_no "
    f"HAVING count(*) = {MERGE})"
)


def _numbered_beats(spark, sf_dir):
    return _windows(spark, sf_dir).withColumnRenamed("window_no", "beat_no")


@query(
    "g14_merged_average",
    with_ctes(
        "bw",
        long_in_sql(
            f"(SELECT record, merge_no, list_transform(range(1, {W + 1}), lambda i: (run[1][i] + run[2][i] + run[3][i]) / 3) "
            f"AS beat FROM {_RUNS})",
            "record, merge_no",
        ),
    ),
)
def merged_average(spark, sf_dir):
    out = signal.merge_beats(_numbered_beats(spark, sf_dir), KEYS, MERGE, MERGE_STRIDE, "average")
    return _long(out, "record", "merge_no")


@query(
    "g14_merged_concat",
    with_ctes("bw", long_in_sql(f"(SELECT record, merge_no, flatten(run) AS beat FROM {_RUNS})", "record, merge_no")),
)
def merged_concat(spark, sf_dir):
    out = signal.merge_beats(_numbered_beats(spark, sf_dir), KEYS, MERGE, MERGE_STRIDE, "concat")
    return _long(out, "record", "merge_no")


cte(
    "sl",
    "SELECT user_id, event_type AS lead, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 "
    "AS idx FROM events",
)
cte("bl", windows_in_sql("sl", "user_id, lead", 2, 2), ("sl",))


def keyed_samples(spark, sf_dir, *keys, **extra):
    """Samples numbered in each key; ``extra`` adds columns of the events table."""
    events = table(spark, sf_dir, "events")
    for name, column in extra.items():
        events = events.withColumn(name, column)
    placed = numbered(events, list(keys), ["ts", "event_id"], F.col("ts").cast("date"), "__rn")
    return placed.select(*keys, (F.col("__rn") - 1).alias("idx"), "value", F.col("ts").cast("date").alias("date"))


@query(
    "g15_aligned_leads",
    with_ctes(
        "bl",
        "SELECT user_id, window_no AS beat_no, lead, " + r("beat[1]") + " AS first, " + r("beat[2]") + " AS second FROM "
        "(SELECT bl.*, min(n) OVER (PARTITION BY user_id) AS shortest FROM bl JOIN (SELECT user_id, lead, count(*) AS n FROM bl "
        "GROUP BY user_id, lead) USING (user_id, lead)) WHERE window_no < shortest",
    ),
)
def aligned_leads(spark, sf_dir):
    """Leads of a user cut to the shortest one."""
    leads = keyed_samples(spark, sf_dir, "user_id", "event_type").withColumnRenamed("event_type", "lead")
    cut = signal.blind_windows(leads.drop("date"), ["user_id", "lead"], 2, 2).withColumnRenamed("window_no", "beat_no")
    stacked = signal.align_leads(cut, ["user_id"], "lead")
    pairs = stacked.select("user_id", "beat_no", F.explode(F.arrays_zip("leads", "beats")).alias("p"))
    return pairs.select(
        "user_id",
        "beat_no",
        F.col("p.leads").alias("lead"),
        rounded(F.col("p.beats")[0]).alias("first"),
        rounded(F.col("p.beats")[1]).alias("second"),
    )


cte(
    "sm",
    "SELECT record, idx, sum(value) OVER (PARTITION BY record ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS value "
    "FROM sp",
    ("sp",),
)
cte("spk", peaks_in_sql("sm", "record", DEVIATIONS, REFRACTORY), ("sm",))
cte("spe", "SELECT * FROM spk WHERE record IN (SELECT record FROM spk GROUP BY record HAVING count(*) >= 2)", ("spk",))
cte("spp", polarity_in_sql("spe", "sm"), ("spe", "sm"))
cte("srp", refined_in_sql("spe", "spp", "sm"), ("spe", "spp", "sm"))
cte("scb", beats_in_sql("srp", "sm"), ("srp", "sm"))


@query(
    "g16_preprocess",
    with_ctes("scb", long_in_sql(f"(SELECT record, peak, {zscore_in_sql()} AS beat FROM scb)", "record, peak")),
)
def preprocess(spark, sf_dir):
    stored = cut_lineage(samples(spark, sf_dir))
    return _long(signal.preprocess(stored, KEYS, 5, PRE, POST, HALF, DEVIATIONS, REFRACTORY), "record", "peak")


# --- recording statistics: one recording per user and week -----------------------------------------

HR_RATE = 2.0
cte(
    "su",
    "SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY ts, event_id) - 1 AS idx FROM (SELECT user_id, "
    "date_diff('day', DATE '2024-01-01', ts::DATE) // 7 AS week, ts, event_id, ts::DATE AS date, value FROM events)",
)
cte("sul", "SELECT *, CASE WHEN week < 2 THEN 'enroll' ELSE 'probe' END AS role FROM su", ("su",))
cte("upk", peaks_in_sql("su", "user_id, week", 0.0, 2), ("su",))
cte(
    "hr",
    "SELECT user_id, week, count(*) AS n_peaks, CASE WHEN count(*) >= 3 AND 60 * 2 / median(rr) BETWEEN 25 AND 220 THEN "
    "60 * 2 / median(rr) END AS bpm FROM (SELECT *, (peak - lag(peak) OVER (PARTITION BY user_id, week ORDER BY peak))::DOUBLE AS rr "
    "FROM upk) GROUP BY user_id, week",
    ("upk",),
)
cte(
    "ps18",
    "SELECT user_id, role, avg(bpm) AS heart_rate, avg(amp) AS amplitude, count(*) AS n_records, "
    "date_diff('day', min(d0), max(d1))::INT AS span_days FROM (SELECT user_id, role, week, quantile_cont(value, 0.95) - "
    "quantile_cont(value, 0.05) AS amp, min(date) AS d0, max(date) AS d1 FROM sul GROUP BY user_id, role, week) LEFT JOIN hr "
    "USING (user_id, week) GROUP BY user_id, role",
    ("sul", "hr"),
)


def weekly(spark, sf_dir):
    week = F.floor(F.date_diff(F.col("ts").cast("date"), F.to_date(F.lit("2024-01-01"))) / 7)
    rows = keyed_samples(spark, sf_dir, "user_id", "week", week=week)
    return rows.withColumn("role", F.when(F.col("week") < 2, "enroll").otherwise("probe"))


def weekly_statistics(spark, sf_dir):
    return signal.partition_statistics(
        cut_lineage(weekly(spark, sf_dir)), ["user_id", "role"], ["week"], "date", HR_RATE
    )


@query("g17_heart_rate", with_ctes("hr", f"SELECT user_id, week, n_peaks, {r('bpm')} AS bpm FROM hr"))
def heart_rate(spark, sf_dir):
    found = signal.detect_peaks(weekly(spark, sf_dir), ["user_id", "week"], 0.0, 2)
    out = signal.heart_rates(cut_lineage(found), ["user_id", "week"], HR_RATE)
    return out.withColumn("bpm", rounded("bpm"))


@query(
    "g18_partition_statistics",
    with_ctes(
        "ps18",
        f"SELECT user_id, role, {r('heart_rate')} AS heart_rate, {r('amplitude')} AS amplitude, n_records, span_days FROM ps18",
    ),
)
def partition_statistics(spark, sf_dir):
    out = weekly_statistics(spark, sf_dir)
    return out.withColumn("heart_rate", rounded("heart_rate")).withColumn("amplitude", rounded("amplitude"))


T_WIDTH, T_LENGTH = 5, 8
cte("tb", windows_in_sql("sul", "user_id, role, week", T_WIDTH, T_WIDTH), ("sul",))
cte(
    "avt",
    f"SELECT user_id, role, pos, median(value) AS value FROM ({fourier_in_sql('tb', 'user_id, role, week, window_no', T_WIDTH, T_LENGTH)}) "
    "GROUP BY user_id, role, pos",
    ("tb",),
)


def weekly_templates(spark, sf_dir):
    windows = signal.blind_windows(weekly(spark, sf_dir), ["user_id", "role", "week"], T_WIDTH, T_WIDTH)
    return signal.average_template(windows, ["user_id", "role"], T_LENGTH)


@query("g19_average_template", with_ctes("avt", f"SELECT user_id, role, pos, {r('value')} AS value FROM avt"))
def average_template(spark, sf_dir):
    out = weekly_templates(spark, sf_dir)
    return out.select("user_id", "role", F.col("pos").cast("bigint").alias("pos"), rounded("value").alias("value"))


cte("sq", "SELECT vec_id, label, least(greatest(list_aggregate(e, 'kurtosis_pop') / 12, 0), 1) AS q FROM v", ("v",))


def _quality(spark, sf_dir):
    return matching.vectors(spark, sf_dir).select(
        F.col("id").alias("vec_id"), "label", signal.kurtosis_quality(F.col("vec")).alias("q")
    )


@query("g20_kurtosis_quality", with_ctes("sq", f"SELECT vec_id, {r('q')} AS quality FROM sq"))
def kurtosis_quality(spark, sf_dir):
    return _quality(spark, sf_dir).select("vec_id", rounded("q").alias("quality"))


@query(
    "g21_outlier_filter",
    with_ctes(
        "sq",
        "SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY q DESC, vec_id DESC) AS rn, count(*) "
        "OVER (PARTITION BY label) AS n FROM (SELECT vec_id, label, round(q, 4) AS q FROM sq) WHERE q >= 0.01) "
        "WHERE rn <= greatest(1, floor(n * 0.7::DOUBLE))",
    ),
)
def outlier_filter(spark, sf_dir):
    scored = _quality(spark, sf_dir).withColumn("q", F.round("q", 4))
    kept = signal.outlier_filter(scored, ["label"], "q", "vec_id", 0.01, 0.7)
    return kept.select("vec_id", "label")


@query("g21_outlier_filter_probe", with_ctes("sq", "SELECT vec_id FROM sq WHERE round(q, 4) >= 0.01"))
def outlier_filter_probe(spark, sf_dir):
    """Threshold only, as on the probe side."""
    scored = _quality(spark, sf_dir).withColumn("q", F.round("q", 4))
    return signal.outlier_filter(scored, [], "q", "vec_id", 0.01).select("vec_id")


# --- spectra and images ----------------------------------------------------------------------------

FRAME, HOP, BANDS = 16, 8, 4


def spectrum_in_sql(last: str) -> str:
    return (
        f"SELECT record, frame, k, pow(sum(value * w * cos(2 * pi() * k * i / {FRAME})), 2) + pow(sum(value * w * sin(2 * pi() * k * i "
        f"/ {FRAME})), 2) AS p FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / {FRAME}) AS w FROM (SELECT record, value, frame, n, idx + "
        f"{FRAME // 2} - frame * {HOP} AS i FROM (SELECT *, unnest(range(greatest(0, ceil((idx + {FRAME // 2} - {FRAME - 1}) / "
        f"{HOP})::BIGINT), (idx + {FRAME // 2}) // {HOP} + 1)) AS frame FROM (SELECT *, count(*) OVER (PARTITION BY record) AS n "
        f"FROM sp))) WHERE frame <= {last}(n / {HOP})) CROSS JOIN (SELECT unnest(range({FRAME // 2 + 1})) AS k) GROUP BY record, frame, k"
    )


cte("st", spectrum_in_sql("ceil"), ("sp",))
cte("sf", spectrum_in_sql("floor"), ("sp",))


@query(
    "g22_stft",
    with_ctes("st", f"SELECT record, frame, k AS bin, {r(f'ln(p / pow({FRAME} / 2.0::DOUBLE, 2) + 1e-8)', 4)} AS power FROM st"),
)
def stft(spark, sf_dir):
    out = encodings.stft(samples(spark, sf_dir), KEYS, FRAME, HOP)
    return out.select("record", "frame", F.col("bin").cast("bigint").alias("bin"), rounded("power", 4).alias("power"))


_MEL = ", ".join(
    f"({band}, {k}, {w!r}::DOUBLE)"
    for band, row in enumerate(encodings.mel_weights(RATE, FRAME, BANDS))
    for k, w in enumerate(row)
)


@query(
    "g23_mel_spectrogram",
    with_ctes(
        "sf",
        f"SELECT record, frame, band, {r('greatest(db - max(db) OVER (PARTITION BY record), -80)', 4)} AS db FROM (SELECT record, "
        f"frame, band, 10 * log10(greatest(sum(p * w), 1e-10)) AS db FROM sf JOIN (VALUES {_MEL}) m(band, k, w) USING (k) "
        "GROUP BY record, frame, band)",
    ),
)
def mel_spectrogram(spark, sf_dir):
    out = encodings.mel_spectrogram(samples(spark, sf_dir), KEYS, RATE, BANDS, FRAME, HOP)
    return out.select("record", "frame", "band", rounded("db", 4).alias("db"))


cte(
    "gx",
    "SELECT record, window_no, i, c, sqrt(greatest(1 - c * c, 0)) AS s FROM (SELECT record, window_no, i, (m - min(m) OVER w) / "
    "nullif(max(m) OVER w - min(m) OVER w, 0) * 2 - 1 AS c FROM (SELECT record, window_no, i, (beat[2 * i + 1] + beat[2 * i + 2]) / 2 AS m "
    "FROM bw CROSS JOIN (SELECT unnest(range(4))::INT AS i)) WINDOW w AS (PARTITION BY record, window_no))",
    ("bw",),
)


def _field(name: str, method: str, formula: str):
    sql = with_ctes(
        "gx",
        f"SELECT a.record, a.window_no, a.i, b.i AS j, {r(formula, 5)} AS value FROM gx a JOIN gx b ON a.record = b.record AND "
        "a.window_no = b.window_no",
    )

    @query(name, sql)
    def field(spark, sf_dir):
        out = encodings.angular_field(_windows(spark, sf_dir), ["record", "window_no"], 4, method)
        return out.withColumn("value", rounded("value", 5))


_field("g24_angular_field_sum", "summation", "a.c * b.c - a.s * b.s")
_field("g24_angular_field_difference", "difference", "a.s * b.c - a.c * b.s")
cte(
    "dv",
    "SELECT record, window_no, i, beat[i + 1] AS x, beat[i + 2] AS y FROM bw CROSS JOIN (SELECT unnest(range(7))::INT AS i)",
    ("bw",),
)
_DISTANCE = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"


def _recurrence(name: str, threshold: float | None, formula: str):
    sql = with_ctes(
        "dv",
        f"SELECT a.record, a.window_no, a.i, b.i AS j, {r(formula)} AS value FROM dv a JOIN dv b ON a.record = b.record AND "
        "a.window_no = b.window_no",
    )

    @query(name, sql)
    def recurrence(spark, sf_dir):
        out = encodings.recurrence_plot(_windows(spark, sf_dir), ["record", "window_no"], 2, 1, threshold)
        return out.withColumn("value", rounded("value"))


_recurrence("g25_recurrence_distance", None, _DISTANCE)
_recurrence("g25_recurrence_threshold", 30.0, f"({_DISTANCE} <= 30)::INT")

_SHARE = 25.0


def _recurrence_share(name: str, mode: str, limit: str):
    """Threshold from the segment's own distances."""
    sql = with_ctes(
        "dv",
        f"SELECT record, window_no, i, j, (d < {limit} OVER (PARTITION BY record, window_no))::INT::DOUBLE AS value FROM "
        f"(SELECT a.record, a.window_no, a.i, b.i AS j, {_DISTANCE} AS d FROM dv a JOIN dv b ON a.record = b.record AND "
        "a.window_no = b.window_no)",
    )

    @query(name, sql)
    def recurrence(spark, sf_dir):
        return encodings.recurrence_plot(_windows(spark, sf_dir), ["record", "window_no"], 2, 1, mode, _SHARE)


_recurrence_share("g25_recurrence_point", "point", f"quantile_cont(d, {_SHARE / 100})")
_recurrence_share("g25_recurrence_distance_share", "distance", f"{_SHARE / 100} * max(d)")


# --- augmentation ----------------------------------------------------------------------------------

SEED = 7


def uniform_in_sql(key: str, start: int = 1) -> str:
    return f"(('0x' || substr(md5({key}), {start}, 8))::BIGINT / 4294967296.0::DOUBLE)"


def normal_in_sql(key: str) -> str:
    return (
        f"(sqrt(-2 * ln((('0x' || substr(md5({key}), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE)) * cos(2 * pi() * "
        f"{uniform_in_sql(key, 9)}))"
    )


cte("xl", "SELECT vec_id, label, e, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i FROM v", ("v",))
_ROW, _CELL = f"'{SEED}|' || vec_id", f"'{SEED}|' || vec_id || '|' || i"
_COPY_ROW = "(7 + copy) || '|' || vec_id"
_STD = "list_aggregate(e, 'stddev_pop')"


def _augmented(name: str, build, value: str, needs: str = "xl", source: str = "xl"):
    sql = with_ctes(needs, f"SELECT vec_id, i AS pos, {r(value)} AS value FROM {source}")

    @query(name, sql)
    def run(spark, sf_dir):
        changed = matching.vectors(spark, sf_dir).withColumn("vec", build(F.col("vec"), F.col("id"), SEED))
        out = changed.select(F.col("id").alias("vec_id"), F.posexplode("vec").alias("pos", "value"))
        return out.select("vec_id", F.col("pos").cast("bigint").alias("pos"), rounded("value").alias("value"))


_augmented("a01_gaussian_noise", augment.gaussian, f"x + 0.01 * {_STD} * {normal_in_sql(_CELL)}")
_augmented("a02_amplitude", augment.amplitude, f"x * (0.8 + (1.2::DOUBLE - 0.8::DOUBLE) * {uniform_in_sql(_ROW)})")
_augmented(
    "a03_timeshift",
    augment.timeshift,
    f"e[((i - (('0x' || substr(md5({_ROW}), 1, 8))::BIGINT % 21 - 10)) % 64 + 64) % 64 + 1]",
)
_augmented(
    "a04_baseline_wander",
    lambda vec, row, seed: augment.baseline_wander(vec, row, seed, RATE),
    f"x + 0.05 * sin(2 * pi() * 0.3 * i / {RATE} + 2 * pi() * {uniform_in_sql(_ROW)})",
)
cte(
    "tw",
    "SELECT vec_id, e, list_transform(range(6), lambda k: coalesce(list_sum(z[1:k]), 0) * 63 / list_sum(z)) AS w FROM (SELECT vec_id, "
    f"e, list(exp(0.2 * {normal_in_sql(_CELL)}) ORDER BY i) AS z FROM (SELECT vec_id, e, unnest(range(5)) AS i FROM v) GROUP BY vec_id, e)",
    ("v",),
)
cte(
    "tx",
    "SELECT vec_id, e, list_transform(range(64), lambda i: w[least(floor(i * 5 / 63.0::DOUBLE)::INT, 4) + 1] + (w[least(floor(i * 5 / "
    "63.0::DOUBLE)::INT, 4) + 2] - w[least(floor(i * 5 / 63.0::DOUBLE)::INT, 4) + 1]) * (i * 5 / 63.0::DOUBLE - least(floor(i * 5 / "
    "63.0::DOUBLE)::INT, 4))) AS m FROM tw",
    ("tw",),
)
cte(
    "ty",
    "SELECT vec_id, e, m, i, greatest(len(list_filter(m, lambda t: t <= i)), 1) AS k FROM (SELECT *, unnest(range(64)) AS i FROM tx)",
    ("tx",),
)
_augmented(
    "a05_time_warp",
    augment.time_warp,
    "CASE WHEN k < 64 AND i > m[k] THEN e[k] + (e[k + 1] - e[k]) * (i - m[k]) / (m[k + 1] - m[k]) ELSE e[k] END",
    "ty",
    "ty",
)
_HOLE = "(('0x' || substr(md5('7|' || vec_id || '|' || {h}), 1, 8))::BIGINT % 55)"
_augmented(
    "a06_cutout",
    lambda vec, row, seed: augment.cutout(vec, row, seed, holes=2, length=10),
    f"CASE WHEN i BETWEEN {_HOLE.format(h=0)} AND {_HOLE.format(h=0)} + 9 OR i BETWEEN {_HOLE.format(h=1)} AND "
    f"{_HOLE.format(h=1)} + 9 THEN 0 ELSE x END",
)
cte(
    "nz",
    f"SELECT vec_id, i, x, {_STD} AS sd, z - coalesce(lag(z) OVER (PARTITION BY vec_id ORDER BY i), 0) AS d FROM "
    f"(SELECT *, {normal_in_sql(_CELL)} AS z FROM xl)",
    ("xl",),
)
_augmented(
    "a07_emg_noise",
    augment.emg_noise,
    "x + d * 0.05 * (sd + 1e-8) / (stddev_pop(d) OVER (PARTITION BY vec_id) + 1e-8)",
    "nz",
    "nz",
)


@query(
    "a08_augmented_training",
    with_ctes(
        "v",
        "SELECT vec_id, copy, count(*) AS n_values, " + r("sum(y * (i + 1))") + " AS checksum FROM (SELECT vec_id, 0 AS copy, "
        "unnest(e) AS y, generate_subscripts(e, 1) - 1 AS i FROM v UNION ALL SELECT vec_id, copy, unnest(list_transform(e, lambda x: "
        "x * (0.8 + (1.2::DOUBLE - 0.8::DOUBLE) * u))) AS y, generate_subscripts(e, 1) - 1 + s AS i FROM (SELECT *, "
        + uniform_in_sql(_COPY_ROW) + " AS u, 0 AS s FROM v CROSS JOIN (SELECT unnest([1, 2]) AS copy))) GROUP BY "
        "vec_id, copy",
    ),
)
def augmented_training(spark, sf_dir):
    """Originals and two scaled copies of every vector."""
    out = augment.augment(matching.vectors(spark, sf_dir), {"amplitude": {}}, 2, SEED)
    weighted = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        F.col("id").alias("vec_id"), "copy", F.size("vec").cast("bigint").alias("n_values"), rounded(weighted).alias("checksum")
    )


@query(
    "a08_augmented_chain",
    with_ctes(
        "xl",
        f"SELECT vec_id, copy, i AS pos, {r('y')} AS value FROM (SELECT vec_id, 0 AS copy, i, x AS y FROM xl UNION ALL SELECT vec_id, copy, i, "
        "e[((i - (('0x' || substr(md5((7 + copy) || '|' || vec_id), 1, 8))::BIGINT % 21 - 10)) % 64 + 64) % 64 + 1] * "
        f"(0.8 + (1.2::DOUBLE - 0.8::DOUBLE) * {uniform_in_sql(_COPY_ROW)}) "
        "FROM xl CROSS JOIN (SELECT unnest([1, 2]) AS copy))",
    ),
)
def augmented_chain(spark, sf_dir):
    """Two steps per copy: shift, then scale."""
    out = augment.augment(matching.vectors(spark, sf_dir), {"timeshift": {}, "amplitude": {}}, 2, SEED)
    long = out.select(F.col("id").alias("vec_id"), "copy", F.posexplode("vec").alias("pos", "value"))
    return long.select("vec_id", "copy", F.col("pos").cast("bigint").alias("pos"), rounded("value").alias("value"))
