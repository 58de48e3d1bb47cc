"""Spectra and image encodings of recordings and segments."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from probeline.functions.columns import array_sum, let
from probeline.operators.signal import row_lists


#: Samples of one recording that a task transforms at once, besides neighbours.
CHUNK_SAMPLES = 65536


def _spectra(samples: DataFrame, keys: Sequence[str], width: int, hop: int, closing: bool, scale: float) -> DataFrame:
    """Power per frequency of Hann-windowed frames centred on multiples of ``hop``, zeros beyond the recording.

    ``closing`` adds the frame that completes a last partial hop. Tasks get runs of frames as one array of samples, so only
    the samples at a run's ends are copied, and transform all frames of a run at once. Frames without a sample are left out.
    """
    keys = list(keys)
    run = max(1, CHUNK_SAMPLES // hop)
    facts = samples.groupBy(*keys).agg(F.min("idx").alias("__start"), F.count(F.lit(1)).alias("__n"))
    place = F.col("idx") - F.col("__start") + width // 2
    first = F.greatest(F.ceil((place - width + 1) / hop), F.lit(0))
    last = F.floor(place / hop)
    inside = samples.join(facts, keys).where(first <= last)  # with a wide hop some samples are in no frame
    tagged = inside.withColumn("__run", F.explode(F.sequence(F.floor(first / run), F.floor(last / run))))
    at = (place - F.col("__run") * run * hop).cast("bigint")
    rows = tagged.groupBy(*keys, "__run").agg(
        F.first("__n").alias("__n"), F.collect_list(F.struct(at.alias("at"), F.col("value").cast("double").alias("value"))).alias("__rows")
    )
    out = T.StructType(
        [samples.schema[c] for c in keys] + [T.StructField("frame", T.LongType()), T.StructField("power", T.ArrayType(T.DoubleType()))]
    )
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, flat = row_lists(batch.column(len(keys) + 2))
            place, value = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            for k, (number, n) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                final = -(-n // hop) if closing else n // hop
                count = min(run, final - number * run + 1)
                if count <= 0:
                    continue
                size = (count - 1) * hop + width
                at, own = place[bounds[k] : bounds[k + 1]], value[bounds[k] : bounds[k + 1]]
                inside = (at >= 0) & (at < size)
                dense, held = np.zeros(size), np.zeros(size + 1, np.int64)
                dense[at[inside]] = own[inside]
                held[1:][at[inside]] = 1
                held = np.cumsum(held)
                starts = np.arange(count) * hop
                starts = starts[held[starts + width] > held[starts]]
                frames = np.lib.stride_tricks.sliding_window_view(dense, width)[starts] * window
                spectrum = np.fft.rfft(frames, axis=1)
                power = (spectrum.real**2 + spectrum.imag**2) * scale
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(starts) + 1, dtype=np.int32) * power.shape[1]), pa.array(power.ravel())
                )
                rows = pa.array(np.full(len(starts), k))
                columns = [batch.column(c).take(rows) for c in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(starts // hop + number * run), lists], names=out.names)

    return rows.mapInArrow(transform, out)


def stft(samples: DataFrame, keys: Sequence[str], width: int, hop: int, log_power: bool = True) -> DataFrame:
    """Short-time spectrum ``keys…, frame, bin, power``; the window's sum is scaled out."""
    total = sum(0.5 - 0.5 * math.cos(2 * math.pi * i / width) for i in range(width))
    spectra = _spectra(samples, keys, width, hop, True, 1.0 / total**2)
    out = spectra.select(*keys, "frame", F.posexplode("power").alias("bin", "power"))
    return out.withColumn("power", F.log(F.col("power") + 1e-8)) if log_power else out


def mel_weights(rate: float, width: int, bands: int) -> list[list[float]]:
    """Triangular filters on the mel scale (linear below 1 kHz, logarithmic above), each of unit area."""
    step, knee, log_step = 200.0 / 3, 1000.0, math.log(6.4) / 27

    def to_mel(hz):
        return hz / step if hz < knee else knee / step + math.log(hz / knee) / log_step

    def to_hz(mel):
        return mel * step if mel < knee / step else knee * math.exp(log_step * (mel - knee / step))

    top = to_mel(rate / 2)
    edges = [to_hz(top * i / (bands + 1)) for i in range(bands + 2)]
    rows = []
    for low, mid, high in zip(edges, edges[1:], edges[2:]):
        area = 2.0 / (high - low)
        row = []
        for k in range(width // 2 + 1):
            hz = k * rate / width
            row.append(area * max(0.0, min((hz - low) / (mid - low), (high - hz) / (high - mid))))
        rows.append(row)
    return rows


def mel_spectrogram(
    samples: DataFrame, keys: Sequence[str], rate: float, bands: int, width: int, hop: int, floor_db: float = 80.0
) -> DataFrame:
    """Mel power in dB below the recording's maximum, at most ``floor_db`` down."""
    keys = list(keys)
    spectra = _spectra(samples, keys, width, hop, False, 1.0)
    weights = F.array(*[F.array(*[F.lit(w) for w in row]) for row in mel_weights(rate, width, bands)])
    summed = F.transform(weights, lambda row: array_sum(F.zip_with(row, F.col("power"), lambda w, p: w * p)))
    long = spectra.select(*keys, "frame", F.posexplode(summed).alias("band", "power"))
    db = 10 * F.log10(F.greatest(F.col("power"), F.lit(1e-10)))
    levels = long.withColumn("db", db).drop("power")
    tops = levels.groupBy(*keys).agg(F.max("db").alias("__top"))
    joined = levels.join(tops, keys)
    return joined.withColumn("db", F.greatest(F.col("db") - F.col("__top"), F.lit(-floor_db))).drop("__top")


def paa(x: Column, size: int) -> Column:
    """Means of ``size`` consecutive pieces; piece b starts at floor(b·n/size)."""
    n = F.size(x)
    cut = lambda b: F.floor(b * n / size).cast("int")
    piece = lambda b: F.slice(x, cut(b) + 1, cut(b + 1) - cut(b))
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda b: F.try_divide(array_sum(piece(b)), F.size(piece(b)))
    )


def angular_field(segments: DataFrame, keys: Sequence[str], size: int, method: str = "summation") -> DataFrame:
    """Gramian angular field ``keys…, i, j, value`` of each segment's ``beat``."""
    if method not in ("summation", "difference"):
        raise ValueError(f"unknown method {method!r}")
    short = segments.withColumn("__x", paa(F.col("beat"), size))
    low, high = F.array_min("__x"), F.array_max("__x")
    bounds = F.struct(low.alias("lo"), (high - low).alias("w"))
    # a flat segment has no angle: NULL
    unit = let(bounds, lambda b: F.transform("__x", lambda v: F.try_divide(v - b["lo"], b["w"]) * 2 - 1))
    scaled = short.withColumn("__c", unit).withColumn(
        "__s", F.transform("__c", lambda c: F.sqrt(F.greatest(1 - c * c, F.lit(0.0))))
    )
    rows = scaled.select(*keys, "__c", "__s", F.posexplode("__c").alias("i", "ci"))
    cells = rows.withColumn("si", F.get(F.col("__s"), F.col("i")))
    cells = cells.select(*keys, "i", "ci", "si", F.posexplode(F.arrays_zip("__c", "__s")).alias("j", "o"))
    c, s = F.col("o.__c"), F.col("o.__s")
    value = F.col("ci") * c - F.col("si") * s if method == "summation" else F.col("si") * c - F.col("ci") * s
    return cells.select(*keys, "i", "j", value.alias("value"))


def recurrence_plot(
    segments: DataFrame,
    keys: Sequence[str],
    dimension: int = 1,
    delay: int = 1,
    threshold: float | str | None = None,
    percentage: float = 10.0,
) -> DataFrame:
    """Distances between delay vectors of each segment, or 1 where they are within the threshold.

    ``threshold`` may be a distance, or ``point`` or ``distance``: then a pair counts where it is closer than the ``percentage``
    percentile of the segment's distances, or than that share of its largest one. The percentile is picked by selection
    inside the segment's matrix. Segments shorter than one delay vector give no rows.
    """
    if not (threshold is None or threshold in ("point", "distance") or isinstance(threshold, int | float)):
        raise ValueError(f"unknown threshold {threshold!r}")
    if not 0 <= percentage <= 100:
        raise ValueError("the percentage must lie between 0 and 100")
    keys = list(keys)
    out = T.StructType(
        [segments.schema[c] for c in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())]
    )

    def percentile(distances: np.ndarray) -> float:
        rank = percentage / 100 * (distances.size - 1)
        low = int(rank)
        picked = np.partition(distances.ravel(), [low, min(low + 1, distances.size - 1)])
        near, far = picked[low], picked[min(low + 1, distances.size - 1)]
        return near + (far - near) * (rank - low)

    def plot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, flat = row_lists(batch.column(len(keys)))
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            for k in range(len(batch)):
                beat = values[bounds[k] : bounds[k + 1]]
                n = len(beat) - (dimension - 1) * delay
                if n <= 0:
                    continue
                squares = np.zeros((n, n))
                for d in range(dimension):
                    part = beat[d * delay : d * delay + n]
                    gap = part[:, None] - part[None, :]
                    squares += gap * gap
                found = np.sqrt(squares)
                if threshold == "point":
                    found = found < percentile(found)
                elif threshold == "distance":
                    found = found < percentage / 100 * found.max()
                elif threshold is not None:
                    found = found <= threshold
                i, j = (x.ravel().astype(np.int32) for x in np.indices((n, n)))
                rows = pa.array(np.full(n * n, k))
                columns = [batch.column(c).take(rows) for c in range(len(keys))]
                columns += [pa.array(i), pa.array(j), pa.array(found.ravel().astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return segments.select(*keys, "beat").mapInArrow(plot, out)
