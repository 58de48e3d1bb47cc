"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from probeline.llm.common import stored

#: Bits of the hash; leading hexadecimal digits of md5 of the key.
HASH_BITS = 60
#: Prefix bits that one aggregation over the rows resolves; deeper ones are resolved for oversized buckets alone.
STEP_BITS = 12


def key_hash(keys: Sequence[str]) -> Column:
    """Non-negative 60-bit hash of the key columns as text; a null differs from an empty string."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def row_bytes(columns: Sequence[str]) -> Column:
    """Bytes of the given columns as text; a null has none."""
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0)).cast("bigint")


def prefix(hashes: Column, bits: int) -> Column:
    return F.shiftright(hashes, HASH_BITS - bits) if bits else F.lit(0).cast("bigint")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Buckets ``depth, prefix, rows, bytes`` of a table ``h, bytes``.

    It starts as one bucket of depth 0. A bucket over ``limit`` bytes is split on its next bit, the others stay, so
    bucket depths differ. Each round sums the oversized buckets' rows at several bits at once (tasks sum first)
    and settles what fits at the fewest bits. Rows of one hash can't be split: such a bucket stays whole, at full
    depth if it is too large.
    """
    open_rows, depth = sized, 0
    out: DataFrame | None = None
    while True:
        deepest = min(depth + STEP_BITS, HASH_BITS)
        cells = open_rows.groupBy(prefix(F.col("h"), deepest).alias("cell")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")
        )
        at = cells.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(deepest))))
        at = at.withColumn("prefix", F.expr(f"shiftright(cell, {deepest} - depth)"))
        sums = at.groupBy("depth", "prefix").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
        fits = (F.col("bytes") <= limit) | (F.col("depth") == HASH_BITS)
        sums = stored(sums.withColumn("fits", fits), "bucket_sums")
        parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("fits").alias("parent"))
        known = sums.withColumn("up", F.shiftright("prefix", 1)).join(parents, ["depth", "up"], "left")
        settled = known.where(F.col("fits") & ~F.coalesce("parent", F.lit(False)))
        settled = settled.select("depth", "prefix", "rows", "bytes")
        out = settled if out is None else out.union(settled)
        over = sums.where(~F.col("fits") & (F.col("depth") == deepest)).select(F.col("prefix").alias("cell"))
        if over.isEmpty():
            return stored(out, "directory")
        open_rows = open_rows.join(over, prefix(F.col("h"), deepest) == F.col("cell"), "left_semi")
        depth = deepest + 1


def write_shards(
    df: DataFrame, keys: Sequence[str], folder: str, limit: int, sized_by: Sequence[str] = ("text",)
) -> DataFrame:
    """Write the rows below ``folder`` in one part per bucket, and give the directory:
    ``shard, depth, prefix, rows, bytes``.

    ``keys`` should tell rows apart: rows of one key share a hash and a shard, even if they pass the limit alone, as
    does a single row over it. Null keys and null texts are allowed, an empty table has no shards. All columns are
    written; theirs may not be named ``shard``, such a one is left out.
    """
    columns = [c for c in df.columns if c != "shard"]
    row = F.struct(*columns).alias("row")
    sized = df.select(row, key_hash(keys).alias("h"), row_bytes(sized_by).alias("bytes"))
    buckets = directory(sized.select("h", "bytes"), limit)
    name = F.format_string("%02d-%d", "depth", "prefix")
    buckets = buckets.select(name.alias("shard"), "depth", "prefix", "rows", F.col("bytes"))
    least = buckets.agg(F.coalesce(F.min("depth"), F.lit(0))).first()[0]
    # a bucket is an interval of hashes; all lie inside one prefix of the smallest depth
    low = F.expr(f"shiftleft(prefix, {HASH_BITS} - depth)")
    width = F.expr(f"shiftleft(1L, {HASH_BITS} - depth)")
    spans = buckets.select("shard", low.alias("low"), (low + width).alias("high")).withColumn("at", prefix(F.col("low"), least))
    inside = (prefix(F.col("h"), least) == F.col("at")) & (F.col("h") >= F.col("low")) & (F.col("h") < F.col("high"))
    placed = sized.join(spans, inside).select("row.*", "shard")
    placed.repartition("shard").write.partitionBy("shard").parquet(folder)
    return buckets
