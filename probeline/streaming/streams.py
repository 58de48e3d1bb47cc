"""Streaming forms of the window, sitting, deduplication and grouping operators.

Each reads a stream with an event-time column ``at`` and runs to the end of the available input into a
table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from probeline.session import scratch_path


def event_stream(spark: SparkSession, folder: str, glob: str, schema) -> DataFrame:
    """Parquet files of ``folder`` as a stream with ``at``, an instant that no session time zone moves."""
    files = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 64).parquet(folder)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return files.withColumn("at", F.timestamp_micros(micros))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input, then read the written table."""
    spark = stream.sparkSession
    path, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    running = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", log)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def sliding_windows(
    stream: DataFrame, keys: Sequence[str], size: str, slide: str | None, lateness: str
) -> DataFrame:
    """Count, sum and extremes per key and window; complete windows only. No slide: tumbling windows."""
    timed = stream.withWatermark("at", lateness)
    window = F.window("at", size, slide) if slide else F.window("at", size)
    facts = timed.groupBy(*keys, window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    start, end = F.unix_seconds("w.start"), F.unix_seconds("w.end")
    return facts.select(*keys, start.alias("start_s"), end.alias("end_s"), "n", "total", "low", "high")


def sittings(stream: DataFrame, keys: Sequence[str], gap: str, lateness: str) -> DataFrame:
    """Visits separated by at least ``gap``; rows behind the watermark are dropped."""
    facts = stream.withWatermark("at", lateness).groupBy(*keys, F.session_window("at", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )
    return facts.select(*keys, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "total")


def without_repeats(stream: DataFrame, content: Sequence[str], lateness: str) -> DataFrame:
    """Drop content already seen within the watermark delay; state is bounded by it."""
    return stream.withWatermark("at", lateness).dropDuplicatesWithinWatermark(list(content))


def groups_of(stream: DataFrame, block: Sequence[str], row_id: str, k: int) -> DataFrame:
    """Groups of exactly ``k`` rows per block in arrival order. State holds fewer than ``k`` ids and the
    next group number; an incomplete group stays in state and is never written."""
    block = list(block)
    schema = stream.schema
    kept = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in block)

    def collect(key, batches, state: GroupState):
        import pandas as pd

        waiting, number = state.get if state.exists else ([], 0)
        waiting = list(waiting)
        out = []
        for batch in batches:
            # a batch is an Arrow slice of the key's rows, not the whole key
            waiting.extend(int(v) for v in batch[row_id])
            while len(waiting) >= k:
                out.append((*key, number, waiting[:k]))
                waiting, number = waiting[k:], number + 1
            if out:
                yield pd.DataFrame(out, columns=[*block, "group_no", "members"])
                out = []
        state.update((waiting, number))

    return stream.select(*block, row_id).groupBy(*block).applyInPandasWithState(
        collect,
        f"{kept}, group_no bigint, members array<bigint>",
        "waiting array<bigint>, number bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )
