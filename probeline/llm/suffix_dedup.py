"""Removal of bytes that lie in a string of ``SPAN`` bytes which also starts elsewhere in the corpus.

Every window of ``SPAN`` bytes is dealt by the least hash of its ``GRAM``-byte parts, so equal windows of all documents
meet. Neighbouring windows with one such hash travel together as a segment. Hashes that occur once are dropped (but for periodic text), equal
segments become one row with a count, and where a hash has several segments, these are the text of a shard, whose
suffixes are put in order with their common prefixes by external induced sorting (``induced_sort``): a window
is repeated where it shares ``SPAN`` bytes with a neighbour in that order, or where its segment occurs twice. A hash with more than
``GROUP_BYTES`` of segments is dealt again by single windows and their first and last bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema

from probeline.llm.common import batch, lean, mixed, stored, utf8
from probeline.llm.induced_sort import suffixes_downwards
from probeline.session import parallelism, scratch_path

SPAN = 200
GRAM = 32
#: Windows in one segment at most; long runs of one repeated pattern are cut there.
MOST_WINDOWS = 256
#: Bytes of text hashed at once in a task; longer texts are read in overlapping pieces.
PIECE_BYTES = 1 << 20
#: Bytes of segments sorted as one shard, and beyond which one hash's segments are dealt again.
SHARD_BYTES = 4 << 20
LEAST_SHARD_BYTES = 1 << 20
GROUP_BYTES = 32 << 20

_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_FACTOR = 0x9E3779B97F4A7C15

def _longs(*names: str) -> list[tuple[str, pa.DataType]]:
    return [(name, pa.int64()) for name in names]


_CUT = pa.schema([*_longs("k1", "k2", "h", "c", "start"), ("n", pa.int32()), ("again", pa.bool_())])
_SEGMENT = pa.schema([*_longs("h", "c", "copies"), ("bytes", pa.binary())])
_RANGES = pa.schema([*_longs("h", "c"), ("ranges", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))])
_WINDOW = pa.schema([*_longs("h", "c"), ("at", pa.int32()), *_longs("h2", "c2", "copies"), ("bytes", pa.binary())])
_PACKED = pa.schema([*_longs("k1", "k2"), ("z", pa.binary())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = pa.schema([("n_bytes", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_key(data) -> tuple[int, int]:
    """A text's 128-bit hash as two signed numbers."""
    value = xxhash.xxh3_128_intdigest(data)
    return _signed(value >> 64), _signed(value & (1 << 64) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position, by doubling."""
    out, size = _VALUES[data], 1
    while size < GRAM:
        out = out[:-size] * np.uint64(pow(_FACTOR, size, 1 << 64)) + out[size:]
        size *= 2
    return mixed(out)


def _sliding(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of the ``width`` values from each position."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:-rest], values[rest:]) if rest else values


def _least_twice(grams: np.ndarray, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether the least hash of a segment's windows occurs at two places of the segment, as in periodic text."""
    width = SPAN - GRAM + 1
    # a gram is the least of some window if its hash equals the largest of the leasts of the windows around it
    around = np.concatenate((np.zeros(width - 1, np.uint64), hashes, np.zeros(width - 1, np.uint64)))
    places = np.flatnonzero(grams == _sliding(np.maximum, around, width))
    values, codes = np.unique(grams[places], return_inverse=True)
    codes = (codes.astype(np.int64) << 40) | places
    codes.sort()
    own = np.searchsorted(values, hashes[starts]) << 40
    return np.searchsorted(codes, own | (starts + counts + width - 1)) - np.searchsorted(codes, own | starts) > 1


def segments_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first window and number of windows of each segment of the texts between ``offsets``, and whether it may
    repeat a window in itself."""
    sizes = np.diff(offsets)
    first, last = offsets[:-1][sizes >= SPAN], offsets[1:][sizes >= SPAN] - SPAN
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    grams = _gram_hashes(data)
    hashes = _sliding(np.minimum, grams, SPAN - GRAM + 1)
    n = len(hashes)
    inside = np.zeros(n + 1, np.int8)
    inside[first] += 1
    inside[last + 1] -= 1
    inside = np.cumsum(inside[:n], dtype=np.int8) > 0
    fresh = np.ones(n, bool)
    np.not_equal(hashes[1:], hashes[:-1], out=fresh[1:])
    fresh[first] = True
    starts = np.flatnonzero(fresh & inside)
    ends = fresh.copy()
    ends[last[last + 1 < n] + 1] = True
    stops = np.append(np.flatnonzero(ends), n)
    counts = stops[np.searchsorted(stops, starts, "right")] - starts
    # long runs in equal parts from their start
    parts = -(-counts // MOST_WINDOWS)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, counts = np.repeat(starts, parts) + nth * MOST_WINDOWS, np.repeat(counts, parts) - nth * MOST_WINDOWS
    counts = np.minimum(counts, MOST_WINDOWS)
    return hashes[starts], starts, counts, _least_twice(grams, hashes, starts, counts)


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes before each text's part): whole texts up to ``PIECE_BYTES``, or parts of a longer one."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + PIECE_BYTES, "right")) - 1
        if high > low:
            yield low, offsets[low : high + 1], np.zeros(high - low, np.int64)
            low = high
            continue
        for begin in range(int(offsets[low]), max(int(offsets[low]) + 1, int(offsets[low + 1]) - SPAN + 1), PIECE_BYTES):
            end = min(begin + PIECE_BYTES + SPAN - 1, int(offsets[low + 1]))
            yield low, np.array([begin, end]), np.array([begin - int(offsets[low])])
        low += 1


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for rows in batches:
        data, offsets = utf8(rows.column(0))
        view = memoryview(data)
        keys = np.array([text_key(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64)
        keys = keys.reshape(-1, 2)
        for row, at, before in _pieces(offsets):
            part = data[at[0] : at[-1]]
            hashes, starts, counts, again = segments_of(part, at - at[0])
            ends = (starts + counts + SPAN - 1).tolist()
            view = memoryview(part)
            content = np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), ends)), np.uint64, len(starts))
            of = np.searchsorted(at - at[0], starts, "right") - 1
            columns = {
                "k1": keys[row + of, 0],
                "k2": keys[row + of, 1],
                "h": hashes.view(np.int64),
                "c": content.view(np.int64),
                "start": starts - (at[of] - at[0]) + before[of],
                "n": counts.astype(np.int32),
                "again": again,
            }
            yield batch(columns, _CUT)


def _packed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Key, compressed text and the other columns (as ``own``) of each document."""
    own = F.struct(*columns) if columns else F.struct(F.lit(0).alias("none"))
    rows = docs.select(own.alias("own"), F.col("text").cast("string").alias("text"))
    kind = T.StructType([rows.schema["own"], *from_arrow_schema(_PACKED).fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for rows in batches:
            data, offsets = utf8(rows.column(1))
            view, own = memoryview(data), rows.column(0)
            cuts = offsets.tolist()
            for low in range(0, len(rows), 1000):
                bits = [view[a:b] for a, b in zip(cuts[low : low + 1000], cuts[low + 1 : low + 1001])]
                keys = [text_key(x) for x in bits]
                yield pa.RecordBatch.from_arrays(
                    [
                        own.slice(low, len(bits)),
                        pa.array([a for a, _ in keys], pa.int64()),
                        pa.array([b for _, b in keys], pa.int64()),
                        pa.array([compress(x) for x in bits], pa.binary()),
                    ],
                    names=["own", "k1", "k2", "z"],
                )

    return rows.mapInArrow(lean(pack), kind)


def _once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once in a row of equal ones, so copies do not all travel."""
    seen: set = set()
    for rows in batches:
        keys = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
        fresh = []
        for k, key in enumerate(keys):
            if key not in seen:
                fresh.append(k)
                seen.add(key)
        if len(seen) > 200_000:
            seen.clear()
        yield rows.take(pa.array(fresh, pa.int64()))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments of each text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for rows in batches:
        for k in range(len(rows)):
            text = unpack(rows.column(0)[k].as_py())
            wanted = rows.column(1)[k].values
            start = wanted.field("start").to_pylist()
            size = wanted.field("n").to_pylist()
            columns = {name: wanted.field(name) for name in ("h", "c", "copies")}
            columns["bytes"] = [text[a : a + n + SPAN - 1] for a, n in zip(start, size)]
            yield batch(columns, _SEGMENT)


def _repeats_in(h: list, c: list, copies: list, parts: list[bytes], folder: str) -> pa.RecordBatch:
    """Ranges of windows of the segments of one shard that are repeated."""
    sizes = np.array([len(p) for p in parts])
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    symbols = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(2)
    symbols[at[1:] - 1] = 1  # between segments
    repeated = np.zeros(len(symbols) + 1, bool)
    last, carry = -1, False
    for positions, near in suffixes_downwards(symbols, folder):
        near_enough = near >= SPAN
        repeated[positions[near_enough]] = True
        if near_enough[0] and last >= 0:
            repeated[last] = True
        repeated[positions[:-1][near_enough[1:]]] = True
        last = int(positions[-1])
    marks = np.zeros(len(symbols) + 1, np.int8)
    marks[at[:-1]] += 1
    marks[at[1:] - SPAN] -= 1
    window = np.cumsum(marks[:-1], dtype=np.int8) > 0
    often = np.repeat(np.array(copies) > 1, sizes + 1)
    flags = np.concatenate(([0], ((repeated[:-1] | often) & window).astype(np.int8), [0]))
    change = np.diff(flags)
    low, high = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    of = np.searchsorted(at, low, "right") - 1
    segments, first = np.unique(of, return_index=True)
    lists = pa.ListArray.from_arrays(
        np.append(first, len(low)).astype(np.int32),
        pa.StructArray.from_arrays(
            [pa.array((low - at[of]).astype(np.int32)), pa.array((high - at[of]).astype(np.int32))], ["low", "high"]
        ),
    )
    take = lambda x: pa.array(np.array(x, np.int64)[segments])
    return pa.RecordBatch.from_arrays([take(h), take(c), lists.cast(_RANGES.field("ranges").type)], schema=_RANGES)


def _compared(segments: DataFrame, n_bytes: int, folder: str) -> DataFrame:
    """``h, c, ranges``: the repeated windows of each segment among those of the same ``h``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, copies, parts, size, seen, last = [], [], [], [], 0, set(), None
        for rows in batches:
            for a, b, k, x in zip(*(rows.column(i).to_pylist() for i in range(4))):
                if a != last:
                    if size >= SHARD_BYTES:
                        yield _repeats_in(h, c, copies, parts, folder)
                        h, c, copies, parts, size = [], [], [], [], 0
                    last = a
                    seen.clear()
                if b not in seen:  # a text in several tasks gives a segment several times
                    seen.add(b)
                    h.append(a)
                    c.append(b)
                    copies.append(k)
                    parts.append(x)
                    size += len(x)
        if parts:
            yield _repeats_in(h, c, copies, parts, folder)

    few = min(parallelism(segments.sparkSession), -(-n_bytes // LEAST_SHARD_BYTES))
    shards = max(1, few, -(-n_bytes // SHARD_BYTES))
    return segments.repartition(shards, "h").sortWithinPartitions("h").mapInArrow(lean(compare), from_arrow_schema(_RANGES))


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of segments one by one, under a hash of their first and last eight bytes."""
    digest = xxhash.xxh3_64_intdigest
    for rows in batches:
        for h, c, copies, text in zip(*(rows.column(i).to_pylist() for i in range(4))):
            parts = [text[k : k + SPAN] for k in range(len(text) - SPAN + 1)]
            columns = {
                "h": [h] * len(parts),
                "c": [c] * len(parts),
                "at": list(range(len(parts))),
                "h2": [_signed(digest(p[:8] + p[-8:], seed=h & 0xFFFFFFFF)) for p in parts],
                "c2": [_signed(digest(p)) for p in parts],
                "copies": [copies] * len(parts),
                "bytes": parts,
            }
            yield batch(columns, _WINDOW)


def _compared_singly(segments: DataFrame, folder: str) -> DataFrame:
    """As ``_compared`` for hashes with too many segments: window by window, equal ones folded first."""
    windows = stored(
        segments.dropDuplicates(["h", "c"]).mapInArrow(
            lean(_single_windows), from_arrow_schema(_WINDOW)
        ),
        "windows",
    )
    kinds = windows.groupBy("h2", "c2").agg(F.sum("copies").alias("copies"))
    met = kinds.groupBy("h2").agg(F.count(F.lit(1)).alias("kinds"))
    folded = stored(kinds.join(met, "h2").where("kinds > 1 OR copies > 1"), "folded")
    texts = windows.select("h2", "c2", "bytes").join(folded.where("kinds > 1"), ["h2", "c2"]).dropDuplicates(["h2", "c2"])
    n_bytes = folded.where("kinds > 1").count() * SPAN
    compared = _compared(texts.selectExpr("h2 AS h", "c2 AS c", "copies", "bytes"), n_bytes, folder)
    repeated = compared.selectExpr("h AS h2", "c AS c2").union(folded.where("kinds = 1").select("h2", "c2"))
    return (
        windows.select("h", "c", "at", "h2", "c2")
        .join(repeated, ["h2", "c2"])
        .groupBy("h", "c")
        .agg(F.collect_set(F.struct(F.col("at").alias("low"), (F.col("at") + 1).alias("high"))).alias("ranges"))
    )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own columns, size, removed spans and remaining bytes of each text."""
    unpack = zstandard.ZstdDecompressor().decompress
    for rows in batches:
        for k0 in range(0, len(rows), 500):
            part = rows.slice(k0, 500)
            sizes, spans, kept = [], [], []
            ranges = part.column(2)
            for k in range(len(part)):
                text = unpack(part.column(1)[k].as_py())
                sizes.append(len(text))
                found = ranges[k]
                if not found.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                low, high = (found.values.field(i).to_numpy() for i in range(2))
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order]) + SPAN - 1
                fresh = np.concatenate(([True], low[1:] > high[:-1]))
                starts, ends = low[fresh].tolist(), high[np.append(fresh[1:], True)].tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(starts, ends)])
                kept.append(b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
                names=["own", "n_bytes", "spans", "kept"],
            )


def find_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_bytes``, ``spans`` (start and end of each maximal run of bytes to
    remove) and ``kept`` (the other bytes; a cut may fall inside a character).

    A byte goes if a string of ``SPAN`` bytes that covers it also starts elsewhere in any text, judged on the
    texts as given. A null text is empty; texts below ``SPAN`` bytes lose nothing; repeated rows repeat each
    other; an empty table gives none. A column of ``docs`` named like a result is replaced by it.
    """
    columns = [c for c in docs.columns if c not in ("text", "n_bytes", "spans", "kept")]
    folder = scratch_path(docs.sparkSession, "runs")
    cuts = stored(docs.select(F.col("text").cast("string")).mapInArrow(lean(_cut_texts), from_arrow_schema(_CUT)), "segments")
    often = cuts.groupBy("h").agg(F.count(F.lit(1)).alias("met"), F.max("again").alias("again")).where("met > 1 OR again")
    found = stored(cuts.drop("again").join(often.select("h"), "h"), "repeated_hashes")
    kinds = found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "start", "n")).alias("at"))
    groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("at.n") + SPAN - 1).alias("bytes"))
    folded = stored(kinds.join(groups, "h").selectExpr("h", "c", "copies", "at.*", "kinds", "bytes"), "folded_segments")
    differing = folded.where("kinds > 1 OR copies = 1")
    n_bytes, large = differing.agg(F.sum(F.col("n") + SPAN - 1), F.max("bytes")).first()
    repeated = folded.where("kinds = 1 AND copies > 1").select(
        "h", "c", F.array(F.struct(F.lit(0).alias("low"), F.col("n").alias("high"))).alias("ranges")
    )
    if n_bytes:
        wanted = differing.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "copies", "start", "n")).alias("wanted"))
        texts = _packed(docs, []).select("k1", "k2", "z").mapInArrow(lean(_once_per_task), from_arrow_schema(_PACKED))
        segments = texts.join(wanted, ["k1", "k2"]).select("z", "wanted").mapInArrow(lean(_fetch), from_arrow_schema(_SEGMENT))
        if large > GROUP_BYTES:
            segments = stored(segments, "segment_bytes")
            hot = differing.where(F.col("bytes") > GROUP_BYTES).select("h").distinct()
            single = _compared_singly(segments.join(hot, "h", "left_semi"), folder)
            segments = segments.join(hot, "h", "left_anti")
            repeated = repeated.union(stored(single, "single_windows"))
        repeated = repeated.union(stored(_compared(segments, n_bytes, folder), "repeated_windows"))
    spans = (
        found.join(repeated, ["h", "c"])
        .select("k1", "k2", "start", F.explode("ranges").alias("r"))
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct((F.col("start") + F.col("r.low")).alias("low"), (F.col("start") + F.col("r.high")).alias("high"))).alias("ranges"))
    )
    packed = _packed(docs, columns)
    joined = packed.join(spans, ["k1", "k2"], "left").select("own", "z", "ranges")
    out = joined.mapInArrow(lean(_without), T.StructType([packed.schema["own"], *from_arrow_schema(_RESULT).fields]))
    return out.select(*[F.col("own")[c].alias(c) for c in columns], "n_bytes", "spans", "kept")
