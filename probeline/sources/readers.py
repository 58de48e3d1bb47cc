"""Scans: text recordings, headers, catalogues, minute ranges and result records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _folder(path: Column, level: int) -> Column:
    """Name of the ``level``-th folder above the file; ``key=`` of a partition folder is removed."""
    name = F.element_at(F.split(path, "/"), -1 - level)
    return F.regexp_replace(F.url_decode(name), "^[^=/]*=", "")


def _lines(text: Column) -> Column:
    """Data lines of a text recording: no comments, no blank lines."""
    return F.filter(F.split(text, "\r?\n"), lambda s: (F.trim(s) != "") & ~F.startswith(F.ltrim(s), F.lit("#")))


def session_folders(spark: SparkSession, root: str, first_samples: int | None = None, glob: str = "*.txt") -> DataFrame:
    """Recordings below ``root/session/subject/``: one value per line, ``#`` comments skipped, the first
    samples only if asked. Hidden files are ignored by the file index.

    A file is one recording and is read whole, so its line numbers are its sample numbers.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    named = files.select(_folder(path, 2).alias("session"), _folder(path, 1).alias("subject"), _lines(F.col("value")).alias("l"))
    kept = F.col("l") if first_samples is None else F.slice("l", 1, first_samples)
    long = named.select("session", "subject", F.posexplode(kept).alias("sample_idx", "t"))
    return long.select("session", "subject", F.col("sample_idx").cast("bigint").alias("sample_idx"), F.trim("t").cast("double").alias("value"))


def file_info(name: Column) -> Column:
    """``date-subject-session-unit`` of a recording's name; an unreadable date is an error."""
    parts = F.split(name, "-")
    date = F.try_to_timestamp(F.get(parts, F.lit(0)), F.lit("yyyyMMdd")).cast("date")
    checked = F.when(date.isNull(), F.raise_error(F.concat(F.lit("no date in name: "), name)).cast("date")).otherwise(date)
    return F.struct(
        checked.alias("date"),
        F.get(parts, F.lit(1)).alias("subject"),
        F.get(parts, F.lit(2)).alias("session"),
        F.get(parts, F.lit(3)).alias("unit"),
    )


def named_recordings(spark: SparkSession, root: str, column: int, separator: str = ",", glob: str = "*.txt") -> DataFrame:
    """Delimited text recordings whose folder name carries their metadata; lines without the wanted
    column fall back to the first one."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    named = files.select(_folder(F.col("_metadata.file_path"), 1).alias("name"), _lines(F.col("value")).alias("l"))
    long = named.withColumn("info", file_info(F.col("name"))).select("info.*", F.posexplode("l").alias("sample_idx", "t"))
    cells = F.split("t", separator)
    value = F.coalesce(F.get(cells, F.lit(column)), F.get(cells, F.lit(0)))
    return long.select(
        "date", "subject", "session", "unit", F.col("sample_idx").cast("bigint").alias("sample_idx"), F.trim(value).cast("double").alias("value")
    )


#: Date formats tried in comment lines, in this order.
COMMENT_DATES = (
    (r"(\d{2}/\d{2}/\d{4})", "dd/MM/yyyy"),
    (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    (r"(\d{2}\.\d{2}\.\d{4})", "dd.MM.yyyy"),
)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Metadata without signals: header blocks separated by blank lines.

    The first line is ``record leads rate samples``; the date comes from the comment lines, in one of
    three formats, and stays NULL if none fits.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    first = F.split(F.element_at(F.split("value", "\n"), 1), r"\s+")
    comments = F.concat_ws("\n", F.filter(F.split("value", "\n"), lambda s: F.startswith(s, F.lit("#"))))
    dates = [
        F.try_to_timestamp(F.nullif(F.regexp_extract(comments, pattern, 1), F.lit("")), F.lit(form)).cast("date")
        for pattern, form in COMMENT_DATES
    ]
    return blocks.select(
        F.get(first, F.lit(0)).alias("record"),
        F.get(first, F.lit(2)).cast("double").alias("rate"),
        F.get(first, F.lit(3)).cast("bigint").alias("n_samples"),
        F.coalesce(*dates).alias("date"),
    )


CATALOGUE = "record bigint, subject bigint, recorded string, low_path string, high_path string"


def catalogue(spark: SparkSession, path: str, resolution: str, subjects: int | None = None) -> DataFrame:
    """CSV catalogue with the path of one resolution; optionally only the first subjects to appear."""
    if resolution not in ("low", "high"):
        raise ValueError(f"unknown resolution {resolution!r}")
    rows = spark.read.csv(path, schema=CATALOGUE, header=True, mode="FAILFAST")
    rows = rows.select("record", "subject", "recorded", F.col(f"{resolution}_path").alias("path"))
    if subjects is None:
        return rows
    first = rows.groupBy("subject").agg(F.min("record").alias("__first")).orderBy("__first", "subject").limit(subjects)
    return rows.join(first.select("subject"), "subject", "left_semi")


def from_manifest(records: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
    """Records named in the manifest, with the manifest's ``position``."""
    return records.join(manifest.select(name, "position"), name)


def minute_ranges(samples: DataFrame, ranges: Sequence[tuple[float, float]], rate: float) -> DataFrame:
    """Samples ``[int(start·60·rate), int(end·60·rate))`` of each range, kept apart by ``segment_no``.

    Ranges are literals, so the bounds reach the file scan.
    """
    bounds = [(int(a * 60 * rate), int(b * 60 * rate)) for a, b in ranges]
    inside = [(F.col("idx") >= a) & (F.col("idx") < b) for a, b in bounds]
    anywhere = inside[0]
    for other in inside[1:]:
        anywhere = anywhere | other
    tags = F.array_compact(F.array(*[F.when(hit, F.lit(i)) for i, hit in enumerate(inside)]))
    return samples.where(anywhere).withColumn("segment_no", F.explode(tags))


RUN_RECORD = T.StructType(
    [
        T.StructField("experiment", T.StringType()),
        T.StructField(
            "per_run_results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("run_index", T.IntegerType()),
                        T.StructField("seed", T.IntegerType()),
                        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
                    ]
                )
            ),
        ),
    ]
)


def result_records(spark: SparkSession, path: str, schema: T.StructType = RUN_RECORD) -> DataFrame:
    """JSON-lines result records; a malformed line fails the scan."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def pick_record(records: DataFrame, identity: dict[str, object]) -> DataFrame:
    """The one record with the given identity; none or several are an error."""
    chosen = records
    for name, value in identity.items():
        chosen = chosen.where(F.col(name) == F.lit(value))
    found = chosen.limit(2).count()
    if found != 1:
        raise ValueError("no record matches" if found == 0 else "several records match")
    return chosen


def run_metrics(records: DataFrame) -> DataFrame:
    """Nested run records to rows ``experiment, run_index, seed, metric, value``."""
    runs = records.select("experiment", F.inline("per_run_results"))
    return runs.select("experiment", "run_index", "seed", F.explode_outer("metrics").alias("metric", "value"))


def subject_scores(spark: SparkSession, path: str) -> DataFrame:
    """Two-column CSV ``subject, score``."""
    return spark.read.csv(path, schema="subject bigint, score double", header=True, mode="FAILFAST")


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Artifact files with size and SHA-256. For files that fit one row (artifacts, not big tables)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", _folder(F.col("path"), 1).alias("folder"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
