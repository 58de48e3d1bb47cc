"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from probeline.session import scratch_path

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of text handled at once inside a task.
SLICE_BYTES = 8 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where ``stored`` writes.
SCRATCH = re.compile(r"/probeline-[0-9a-f]{32}/[^/]+$")

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later jobs neither repeat the work nor depend on executors.
    Shuffle files of the step go when it is written, not when the driver happens to collect its garbage."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Empty tables made by ``stored`` that nothing reads any more, so that their room serves the next step."""
    for df in frames:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        if not all(SCRATCH.search(f) for f in folders):
            raise ValueError("only tables in the scratch folder may be emptied")
        for folder in folders:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` for ``mapInArrow``, after which the task gives freed memory back: Python workers live on, and would else
    keep the peak of every earlier step beside the next one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library: its memory stays with the worker

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(df_bytes: int, per_part: int, least: int) -> int:
    return max(least, math.ceil(df_bytes / per_part))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row stands alone."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = high


def blank_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case: a code per word, the distinct words, words before each row."""
    data = _LOWER[data]
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    array = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[word]))]
    ).dictionary_encode()
    codes = array.indices.to_numpy(zero_copy_only=False)
    return codes, array.dictionary, np.searchsorted(starts, offsets)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A signed 64-bit hash per distinct word."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words.to_pylist()), np.uint64, len(words)).view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
