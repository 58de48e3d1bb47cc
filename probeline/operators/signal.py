"""Filters, peaks, windows and segment transforms on long samples ``(keys…, idx, value)``.

A recording may be very long, so nothing is windowed over a whole recording: samples are cut into
chunks by index, each with the few neighbouring samples its window needs. Segments (beats, windows)
are short arrays and are transformed in place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from probeline.functions.columns import array_sum, let
from probeline.functions.ordering import exact_percentiles, numbered, prior_max, running_sum, with_value_bucket
from probeline.session import cut_lineage

CHUNK = 65536
BIN = 1024


def _chunked(samples: DataFrame, before: int, after: int) -> DataFrame:
    """Copy each sample to the chunks that need it; ``__own`` marks the chunk it belongs to."""
    if max(before, after) > CHUNK:
        raise ValueError(f"a window may reach at most {CHUNK} samples to each side")
    home, offset = F.floor(F.col("idx") / CHUNK), F.col("idx") % CHUNK
    tags = F.array_compact(
        F.array(
            home,
            F.when((offset < after) & (home > 0), home - 1),
            F.when(offset >= CHUNK - before, home + 1),
        )
    )
    return samples.withColumn("__chunk", F.explode(tags)).withColumn("__own", F.col("__chunk") == home)


def _local(keys: Sequence[str]):
    return Window.partitionBy(*keys, "__chunk").orderBy("idx")


def _owned(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__own", "__chunk")


def with_start(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``__start``, the first index of each recording or segment, so that a segment read from the middle of a
    recording is treated like one that counts from 0."""
    keys = list(keys)
    return samples.join(samples.groupBy(*keys).agg(F.min("idx").alias("__start")), keys)


def _near(keys: Sequence[str], before: int, after: int):
    """Samples whose index is at most so far away; an index that is missing has none."""
    return _local(keys).rangeBetween(-before, after)


def _without_gaps(n: Column) -> Column:
    """``n``, or an error where a recording's indices ``__start`` to ``__end`` are not all there, once each."""
    whole = F.col("__end") - F.col("__start") + 1 == n
    return F.when(whole, n).otherwise(F.raise_error(F.lit("a recording has missing or repeated indices")).cast("bigint"))


def moving_average(samples: DataFrame, keys: Sequence[str], width: int = 5) -> DataFrame:
    """Mean of ``width`` samples around each one; missing neighbours count as zero."""
    after = (width - 1) // 2
    before = width - 1 - after
    frame = _near(keys, before, after)
    cut = _chunked(samples, before, after)
    return _owned(cut.withColumn("value", F.sum("value").over(frame) / width))


def _neighbours(samples: DataFrame, keys: Sequence[str], half: int) -> DataFrame:
    """Add ``__w``: the ``2 half + 1`` values around each sample, zeros beyond the recording. A recording with a gap raises."""
    keys = list(keys)
    frame = _local(keys).rowsBetween(-half, half)
    ends = samples.groupBy(*keys).agg(
        F.min("idx").alias("__start"), F.max("idx").alias("__end"), F.count(F.lit(1)).alias("__n")
    )
    start = F.when(_without_gaps(F.col("__n")) > 0, F.col("__start"))
    placed = samples.join(ends.select(*keys, start.alias("__start")), keys)
    cut = _chunked(placed, half, half).withColumn("__w", F.collect_list("value").over(frame))
    # int keeps array_repeat's count type; the recording's start is known, so the missing left part is too
    left = F.greatest(F.lit(half) - (F.col("idx") - F.col("__start")), F.lit(0)).cast("int")
    right = (F.lit(2 * half + 1) - F.size("__w") - left).cast("int")
    padded = F.concat(F.array_repeat(F.lit(0.0), left), F.col("__w"), F.array_repeat(F.lit(0.0), right))
    return cut.withColumn("__w", padded).drop("__start")


def median_filter(samples: DataFrame, keys: Sequence[str], kernel: int = 5) -> DataFrame:
    """Median of an odd kernel (an even one is widened by one), zeros beyond the recording."""
    half = kernel // 2
    wide = _neighbours(samples, keys, half)
    return _owned(wide.withColumn("value", F.sort_array("__w")[half]).drop("__w"))


def _recordings(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First index and number of samples of each recording."""
    return samples.groupBy(*keys).agg(
        F.min("idx").alias("__start"), F.max("idx").alias("__end"), F.count(F.lit(1)).alias("__n")
    )


def row_lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Bounds of each row's list in the flat array of all lists' elements."""
    sizes = np.array([0 if size is None else size for size in column.value_lengths().to_pylist()], np.int64)
    return np.concatenate(([0], np.cumsum(sizes))), column.flatten()


def _on_chunks(
    samples: DataFrame,
    keys: Sequence[str],
    before: int,
    after: int,
    work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
    gaps: bool = False,
) -> DataFrame:
    """Replace ``value`` chunk by chunk. A task gets each chunk with its neighbours as one array; ``work`` maps ascending
    indices and values to new values and to which of them to keep. Recordings with gaps raise unless ``gaps``."""
    keys = list(keys)
    others = [c for c in samples.columns if c not in keys and c != "value"]
    rows = _chunked(samples, before, after).groupBy(*keys, "__chunk").agg(
        F.collect_list(F.struct("value", "__own", *others)).alias("__rows")
    )
    if not gaps:
        whole = _recordings(samples, keys)
        rows = rows.join(whole.select(*keys, _without_gaps(F.col("__n")).alias("__n")), keys).where(F.col("__n") > 0)
    out = T.StructType([samples.schema[c] for c in keys] + [T.StructField("value", T.DoubleType())] + [samples.schema[c] for c in others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, flat = row_lists(batch.column(len(keys)))
            index = flat.field("idx").to_numpy(zero_copy_only=False)
            value = flat.field("value").to_numpy(zero_copy_only=False).astype(np.float64)
            own = flat.field("__own").to_numpy(zero_copy_only=False)
            places, values, row = [], [], []
            for k in range(len(batch)):
                order = bounds[k] + np.argsort(index[bounds[k] : bounds[k + 1]], kind="stable")
                new, kept = work(index[order], value[order])
                kept &= own[order]
                places.append(order[kept])
                values.append(new[kept])
                row.append(np.full(int(kept.sum()), k))
            at, of = pa.array(np.concatenate(places)), pa.array(np.concatenate(row))
            columns = [batch.column(k).take(of) for k in range(len(keys))] + [pa.array(np.concatenate(values))]
            columns += [flat.field(c).take(at) for c in others]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return rows.select(*keys, "__rows").mapInArrow(run, out).select(*samples.columns)


#: Kernels with more taps than this are applied in the frequency domain.
DIRECT_TAPS = 32


def convolve(samples: DataFrame, keys: Sequence[str], taps: Sequence[float], interior: bool = False) -> DataFrame:
    """Symmetric-length kernel, first tap on the earliest neighbour. ``interior`` keeps only samples
    whose whole window lies inside the recording; else what lies beyond counts as zero and a recording with a gap raises.

    Long kernels go through the Fourier transform, chunk by chunk with neighbours (overlap-save).
    """
    if len(taps) % 2 == 0:
        raise ValueError("the kernel needs an odd number of taps")
    half, kernel = len(taps) // 2, np.array(taps, np.float64)[::-1]

    def work(index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = int(index[-1] - index[0]) + 1 + 2 * half
        at = index - index[0] + half
        dense, present = np.zeros(size), np.zeros(size + 1, np.int64)
        dense[at] = value
        if len(kernel) <= DIRECT_TAPS:
            out = np.convolve(dense, kernel, "valid")
        else:
            length = 1 << int(size + len(kernel) - 2).bit_length()
            product = np.fft.rfft(dense, length) * np.fft.rfft(kernel, length)
            out = np.fft.irfft(product, length)[2 * half : size]
        if not interior:
            return out[at - half], np.ones(len(at), bool)
        present[1:][at] = 1
        present = np.cumsum(present)
        return out[at - half], present[at + half + 1] - present[at - half] == len(kernel)

    return _on_chunks(samples, keys, half, half, work, gaps=interior)


def savgol_taps(width: int = 11, order: int = 2) -> list[float]:
    """Weights of the local least-squares polynomial at the window's centre."""
    if width % 2 == 0 or order >= width:
        raise ValueError("the window must be odd and longer than the order")
    half = width // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    return [float(t) for t in np.linalg.pinv(basis)[0]]


def bandpass_taps(rate: float, low: float, high: float, taps: int = 101) -> list[float]:
    """Zero-phase band-pass kernel: a Hamming-windowed sinc with unit gain in the middle of the band,
    convolved with its own mirror image (forward and backward filtering)."""
    m = np.arange(taps) - (taps - 1) / 2
    a, b = 2 * low / rate, 2 * high / rate
    ideal = b * np.sinc(b * m) - a * np.sinc(a * m)
    one = ideal * np.hamming(taps)
    one /= (one * np.cos(np.pi * m * (a + b) / 2)).sum()
    return [float(t) for t in np.convolve(one, one[::-1])]


def remove_polynomial(samples: DataFrame, keys: Sequence[str], order: int = 3) -> DataFrame:
    """Subtract each recording's global least-squares polynomial.

    On an even grid the fit decouples in discrete orthogonal polynomials, so the coefficients are plain
    sums that combine map-side; nothing is solved and no recording is gathered. A recording with a gap raises: its
    parts are segments of their own.
    """
    keys = list(keys)
    sizes = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("idx").alias("__start"), F.max("idx").alias("__end")
    )
    sizes = sizes.select(*keys, "__start", _without_gaps(F.col("__n")).cast("double").alias("__n"))
    n = F.col("__n")
    centred = samples.join(sizes, keys).withColumn("__u", F.col("idx") - F.col("__start") - (n - 1) / 2).drop("__start")
    u = F.col("__u")
    basis = [F.lit(1.0), u, u * u - (n * n - 1) / 12, u * u * u - u * (3 * n * n - 7) / 20][: order + 1]
    for k, p in enumerate(basis):
        centred = centred.withColumn(f"__p{k}", p)
    for k in range(len(basis), order + 1):  # the three-term recurrence of these polynomials
        m = k - 1
        step = m * m * (n * n - m * m) / (4 * (4 * m * m - 1))
        centred = centred.withColumn(f"__p{k}", u * F.col(f"__p{m}") - step * F.col(f"__p{m - 1}"))
    sums = []
    for k in range(order + 1):
        p = F.col(f"__p{k}")
        sums += [F.sum(F.col("value") * p).alias(f"__a{k}"), F.sum(p * p).alias(f"__b{k}")]
    fits = centred.groupBy(*keys).agg(*sums)
    joined = centred.join(fits, keys)
    fitted = F.lit(0.0)
    for k in range(order + 1):
        weight = F.when(F.col(f"__b{k}") > 0, F.col(f"__a{k}") / F.col(f"__b{k}")).otherwise(0.0)
        fitted = fitted + weight * F.col(f"__p{k}")
    return joined.select(*samples.columns, fitted.alias("__fit")).withColumn(
        "value", F.col("value") - F.col("__fit")
    ).drop("__fit")


# --- peaks -----------------------------------------------------------------------------------------


def detect_peaks(samples: DataFrame, keys: Sequence[str], deviations: float, refractory: int) -> DataFrame:
    """Peaks ``(keys…, peak)``: local maxima above mean + c·std, and of those closer than the refractory
    gap only the highest (earliest on ties). Missing values are ignored; no peak gives no row."""
    keys = list(keys)
    clean = samples.where(F.col("value").isNotNull() & ~F.isnan("value"))
    levels = clean.groupBy(*keys).agg((F.avg("value") + deviations * F.stddev_pop("value")).alias("__level"))
    cut = _chunked(clean.select(*keys, "idx", "value"), 1, 1)
    shaped = cut.withColumn("__prev", F.lag("value").over(_local(keys))).withColumn(
        "__next", F.lead("value").over(_local(keys))
    )
    tops = _owned(shaped).where((F.col("value") > F.col("__prev")) & (F.col("value") >= F.col("__next")))
    high = tops.join(levels, keys).where(F.col("value") > F.col("__level")).select(*keys, "idx", "value")
    high = high.withColumn("__part", F.floor(F.col("idx") / CHUNK))
    gaps = prior_max(high, keys, ["idx"], "__part", {"__last": "idx"})
    fresh = F.when(F.col("idx") - F.col("__last") <= refractory, 0).otherwise(1)
    runs = running_sum(gaps.withColumn("__fresh", fresh), keys, ["idx"], "__part", "__fresh", "__run")
    best = F.max(F.struct(F.col("value").alias("v"), (-F.col("idx")).alias("i")))
    return runs.groupBy(*keys, "__run").agg(best.alias("b")).select(*keys, (-F.col("b.i")).alias("peak"))


def alignment_half_width(rate: Column, seconds: Column) -> Column:
    """Seconds to samples, half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(rate * seconds).cast("int"))


def around(anchors: DataFrame, samples: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """Samples with ``low <= idx <= high`` of each anchor: a range join as an equi join on index bins."""
    keys = list(keys)
    spread = anchors.withColumn("__low", low).withColumn("__high", high).withColumn(
        "__bin", F.explode(F.sequence(F.floor(F.col("__low") / BIN), F.floor(F.col("__high") / BIN)))
    )
    binned = samples.select(*keys, "idx", "value", F.floor(F.col("idx") / BIN).alias("__bin"))
    hit = (F.col("idx") >= F.col("__low")) & (F.col("idx") <= F.col("__high"))
    return spread.join(binned, [*keys, "__bin"]).where(hit).drop("__bin", "__low", "__high")


def peak_polarity(peaks: DataFrame, samples: DataFrame, keys: Sequence[str], half: int) -> DataFrame:
    """Do the peaks of a recording point up (1) or down (-1)? Summed height above against depth below
    the median around each peak; a tie counts as up."""
    keys = list(keys)
    near = around(peaks, samples, keys, F.col("peak") - half, F.col("peak") + half)
    shape = near.groupBy(*keys, "peak").agg(
        F.max("value").alias("top"), F.min("value").alias("bottom"), F.median("value").alias("mid"),
        F.count(F.lit(1)).alias("n"),
    )
    whole = shape.where(F.col("n") >= 2).groupBy(*keys).agg(
        F.sum(F.col("top") - F.col("mid")).alias("up"), F.sum(F.col("mid") - F.col("bottom")).alias("down")
    )
    return whole.withColumn("polarity", F.when(F.col("down") > F.col("up"), -1).otherwise(1))


def refine_peaks(peaks: DataFrame, samples: DataFrame, keys: Sequence[str], half: int) -> DataFrame:
    """Move each peak to the extreme sample of its surroundings (earliest on ties) and drop duplicates."""
    keys = list(keys)
    signs = peak_polarity(peaks, samples, keys, half).select(*keys, "polarity")
    near = around(peaks.join(signs, keys), samples, keys, F.col("peak") - half, F.col("peak") + half)
    best = F.max(F.struct((F.col("polarity") * F.col("value")).alias("v"), (-F.col("idx")).alias("i")))
    moved = near.groupBy(*keys, "peak").agg(best.alias("b"))
    return moved.select(*keys, (-F.col("b.i")).alias("peak")).distinct()


def cut_beats(peaks: DataFrame, samples: DataFrame, keys: Sequence[str], pre: int, post: int) -> DataFrame:
    """``[peak - pre, peak + post)`` as an array; windows that leave the recording are dropped."""
    keys = list(keys)
    near = around(peaks, samples, keys, F.col("peak") - pre, F.col("peak") + post - 1)
    rows = F.array_sort(F.collect_list(F.struct("idx", "value")))
    beats = near.groupBy(*keys, "peak").agg(F.transform(rows, lambda s: s["value"]).alias("beat"))
    return beats.where(F.size("beat") == pre + post)


def blind_windows(samples: DataFrame, keys: Sequence[str], width: int, stride: int) -> DataFrame:
    """Complete windows ``(keys…, window_no, beat)``. Each sample names the windows it belongs to, so a
    long recording is spread by window instead of being sliced in one task."""
    place = F.col("idx") - F.col("__start")
    first = F.greatest(F.ceil((place - width + 1) / stride), F.lit(0))
    last = F.floor(place / stride)
    tagged = with_start(samples, keys).where(first <= last).withColumn("window_no", F.explode(F.sequence(first, last)))
    rows = F.array_sort(F.collect_list(F.struct("idx", "value")))
    windows = tagged.groupBy(*keys, "window_no").agg(F.transform(rows, lambda s: s["value"]).alias("beat"))
    return windows.where(F.size("beat") == width)


# --- segments --------------------------------------------------------------------------------------


def _mean(x: Column) -> Column:
    return array_sum(x) / F.size(x)


def array_std(x: Column) -> Column:
    """Population standard deviation of an array."""
    return let(_mean(x), lambda m: F.sqrt(array_sum(F.transform(x, lambda v: (v - m) * (v - m))) / F.size(x)))


def normalised(beat: Column, method: str = "zscore", smallest: float = 1e-6) -> Column:
    """z-score or min-max of a segment; a flat one is returned unchanged."""
    if method == "zscore":
        bounds = F.struct(_mean(beat).alias("a"), array_std(beat).alias("w"))
    elif method == "minmax":
        bounds = F.struct(F.array_min(beat).alias("a"), (F.array_max(beat) - F.array_min(beat)).alias("w"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return let(
        bounds,
        lambda b: F.when(b["w"] < smallest, beat).otherwise(F.transform(beat, lambda v: (v - b["a"]) / b["w"])),
    )


def resampled(beat: Column, length: int, method: str = "fourier") -> Column:
    """Segment of a fixed length: through its Fourier coefficients, or linearly between grid points."""
    steps = F.sequence(F.lit(0), F.lit(length - 1))
    n = F.size(beat)
    if method == "linear":
        def at(j):
            place = j * (n - 1) / F.lit(max(length - 1, 1))
            low = F.floor(place).cast("int")
            high = F.least(low + 1, n - 1)
            share = place - low
            return F.get(beat, low) * (1 - share) + F.get(beat, high) * share

        return F.when(n == length, beat).otherwise(F.transform(steps, at))
    if method != "fourier":
        raise ValueError(f"unknown method {method!r}")

    def through_spectrum(beats: pa.Array) -> pa.Array:
        bounds, flat = row_lists(beats)
        values, sizes = flat.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(bounds)
        out = np.empty((len(beats), length))
        for n in np.unique(sizes).tolist():  # segments of one size at once
            rows = np.flatnonzero(sizes == n)
            given = values[bounds[rows][:, None] + np.arange(n)]
            if n == length or n == 0:
                out[rows] = given if n else np.nan
                continue
            spectrum = np.zeros((len(rows), length // 2 + 1), np.complex128)
            shared = min(n, length)
            spectrum[:, : shared // 2 + 1] = np.fft.rfft(given, axis=1)[:, : shared // 2 + 1]
            if shared % 2 == 0:  # the middle coefficient is shared by both halves
                spectrum[:, shared // 2] *= 2.0 if n > length else 0.5
            out[rows] = np.fft.irfft(spectrum, length, axis=1) * (length / n)
        known = beats.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
        starts = pa.array(np.arange(len(beats) + 1, dtype=np.int32) * length)
        lists = pa.ListArray.from_arrays(starts, pa.array(out.ravel()))
        return lists if known.all() else pa.compute.if_else(pa.array(known), lists, pa.scalar(None, lists.type))

    return F.arrow_udf(through_spectrum, T.ArrayType(T.DoubleType()))(beat)


def merge_beats(beats: DataFrame, keys: Sequence[str], k: int, stride: int, how: str = "average") -> DataFrame:
    """Runs of ``k`` consecutive beats (``beat_no`` from 0) averaged or joined end to end."""
    if not 1 <= stride <= k:
        raise ValueError("the stride must lie between 1 and the run length")
    first = F.greatest(F.ceil((F.col("beat_no") - k + 1) / stride), F.lit(0))
    tagged = beats.withColumn("merge_no", F.explode(F.sequence(first, F.floor(F.col("beat_no") / stride))))
    rows = F.array_sort(F.collect_list(F.struct("beat_no", "beat")))
    runs = tagged.groupBy(*keys, "merge_no").agg(F.transform(rows, lambda s: s["beat"]).alias("__run"))
    runs = runs.where(F.size("__run") == k)
    if how == "concat":
        return runs.withColumn("beat", F.flatten("__run")).drop("__run")
    if how != "average":
        raise ValueError(f"unknown merge {how!r}")
    total = F.aggregate(
        F.slice("__run", 2, k), F.col("__run")[0], lambda acc, b: F.zip_with(acc, b, lambda x, y: x + y)
    )
    return runs.withColumn("beat", F.transform(total, lambda v: v / k)).drop("__run")


def align_leads(beats: DataFrame, keys: Sequence[str], lead: str) -> DataFrame:
    """Keep the beat numbers every lead has and stack the leads of a beat in lead order."""
    keys = list(keys)
    per_lead = beats.groupBy(*keys, lead).agg(F.count(F.lit(1)).alias("__n"))
    shortest = per_lead.groupBy(*keys).agg(F.min("__n").alias("__n"))
    kept = beats.join(shortest, keys).where(F.col("beat_no") < F.col("__n"))
    rows = F.array_sort(F.collect_list(F.struct(lead, "beat")))
    return kept.groupBy(*keys, "beat_no").agg(
        F.transform(rows, lambda s: s[lead]).alias("leads"), F.transform(rows, lambda s: s["beat"]).alias("beats")
    )


def preprocess(
    samples: DataFrame,
    keys: Sequence[str],
    smooth: int = 5,
    pre: int = 3,
    post: int = 5,
    half: int = 2,
    deviations: float = 1.0,
    refractory: int = 5,
    method: str = "zscore",
) -> DataFrame:
    """Filter, find and align peaks, cut beats and normalise. Recordings with fewer than two peaks give none."""
    keys = list(keys)
    smoothed = moving_average(samples.select(*keys, "idx", "value"), keys, smooth)
    peaks = detect_peaks(smoothed, keys, deviations, refractory)
    enough = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= 2).drop("__n")
    peaks = refine_peaks(peaks.join(enough, keys, "left_semi"), smoothed, keys, half)
    beats = cut_beats(peaks, smoothed, keys, pre, post)
    return beats.withColumn("beat", normalised(F.col("beat"), method))


# --- statistics of recordings ----------------------------------------------------------------------


def heart_rates(peaks: DataFrame, keys: Sequence[str], rate: float) -> DataFrame:
    """Beats per minute from the median peak distance: needs three peaks and a value in [25, 220]."""
    keys = list(keys)
    before = prior_max(peaks, keys, ["peak"], F.floor(F.col("peak") / CHUNK), {"__last": "peak"})
    gaps = before.select(*keys, (F.col("peak") - F.col("__last")).cast("double").alias("rr"))
    counts = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_peaks"))
    middle = exact_percentiles(gaps.where(F.col("rr") > 0), keys, "rr", {"__rr": 0.5})
    bpm = 60.0 * rate / F.col("__rr")
    usable = (F.col("n_peaks") >= 3) & bpm.between(25.0, 220.0)
    return counts.join(middle, keys, "left").select(*keys, "n_peaks", F.when(usable, bpm).alias("bpm"))


def partition_statistics(
    samples: DataFrame, subject: Sequence[str], record: Sequence[str], date: str, rate: float,
    deviations: float = 0.0, refractory: int = 2,
) -> DataFrame:
    """Per subject and role: mean heart rate, mean 5-95 % amplitude, number of records and days spanned."""
    subject, keys = list(subject), [*subject, *record]
    spans = exact_percentiles(samples, keys, "value", {"__lo": 0.05, "__hi": 0.95})
    peaks = cut_lineage(detect_peaks(samples, keys, deviations, refractory))  # read three times
    rates = heart_rates(peaks, keys, rate).select(*keys, "bpm")
    facts = samples.groupBy(*keys).agg(F.min(date).alias("__d0"), F.max(date).alias("__d1"))
    joined = facts.join(spans, keys).join(rates, keys, "left")
    return joined.groupBy(*subject).agg(
        F.avg("bpm").alias("heart_rate"),
        F.avg(F.col("__hi") - F.col("__lo")).alias("amplitude"),
        F.count(F.lit(1)).alias("n_records"),
        F.date_diff(F.max("__d1"), F.min("__d0")).alias("span_days"),
    )


def average_template(beats: DataFrame, keys: Sequence[str], length: int = 256) -> DataFrame:
    """Coordinate-wise median beat after resampling: ``keys…, pos, value``."""
    sized = beats.withColumn("beat", resampled(F.col("beat"), length))
    long = sized.select(*keys, F.posexplode("beat").alias("pos", "x"))
    return exact_percentiles(long, [*keys, "pos"], "x", {"value": 0.5})


def kurtosis_quality(vec: Column) -> Column:
    """Quality in [0, 1] from Pearson kurtosis: (k - 3) / 12, clipped; a flat signal scores 0."""
    return let(
        _mean(vec),
        lambda m: let(
            F.struct(
                (array_sum(F.transform(vec, lambda x: F.pow(x - m, F.lit(2)))) / F.size(vec)).alias("m2"),
                (array_sum(F.transform(vec, lambda x: F.pow(x - m, F.lit(4)))) / F.size(vec)).alias("m4"),
            ),
            lambda s: F.least(
                F.greatest(
                    (F.when(s["m2"] > 0, s["m4"] / (s["m2"] * s["m2"])).otherwise(0.0) - 3) / 12, F.lit(0.0)
                ),
                F.lit(1.0),
            ),
        ),
    )


def outlier_filter(
    df: DataFrame, keys: Sequence[str], quality: str, row_id: str, threshold: float, keep: float | None = None
) -> DataFrame:
    """Rows of at least ``threshold`` quality; then the best ``max(1, int(n·keep))`` of each key.

    Pass no keys for the probe side, which must not be ranked by subject.
    """
    good = df.where(F.col(quality) >= threshold)
    if keep is None:
        return good
    cut = with_value_bucket(good, keys, quality, 256)
    ranked = numbered(cut, keys, [F.desc(quality), F.desc(row_id)], -F.col("__vb"), "__rn", total="__n")
    kept = ranked.where(F.col("__rn") <= F.greatest(F.lit(1), F.floor(F.col("__n") * keep)))
    return kept.drop("__rn", "__n", "__vb")
