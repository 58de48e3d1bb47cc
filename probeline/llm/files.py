"""Binary files that tasks write into the shared folder."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def write_file(folder: str, name: str, payload: bytes) -> str:
    """Write under another name, then move into place: a repeated task attempt replaces the same bytes and a
    lost one leaves no half file behind."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    draft = f"{path}/_{name}.{uuid.uuid4().hex}"  # readers skip names with a leading underscore
    with system.open_output_stream(draft) as stream:
        stream.write(payload)
    system.move(draft, f"{path}/{name}")
    return f"{folder.rstrip('/')}/{name}"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` and ``content`` of every file of the folder, by Spark's own reader; none where nothing was written."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    return spark.read.format("binaryFile").load(folder).selectExpr("element_at(split(path, '/'), -1) AS name", "content")
