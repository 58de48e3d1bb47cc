"""A corpus pipeline: each stage reads what the one before kept and writes Parquet in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from probeline.llm.common import DOCUMENT_COLUMNS, stored, table
from probeline.llm.decontamination import remove_contamination
from probeline.llm.ngram_join import Measure, without_near_duplicates
from probeline.llm.quality_model import classify_quality
from probeline.llm.secrets import redact_secrets
from probeline.llm.sentence_pieces import encode_pieces
from probeline.session import tune

#: Rows sent to a Python worker at once: some megabytes of text, as tasks work in slices of that size.
BATCH_ROWS = "2000"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is below their language's cutoff."""
    judged = classify_quality(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*DOCUMENT_COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more."""
    return without_near_duplicates(docs, Measure(words=5, share=80))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark cut out."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked."""
    return redact_secrets(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document's best segmentation."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _in_small_batches(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _in_small_batches(good_quality)),
    ("near_duplicates", _in_small_batches(distinct_documents)),
    ("decontamination", _in_small_batches(without_benchmarks)),
    ("secrets", _in_small_batches(without_secrets)),
    ("sentence_pieces", _in_small_batches(as_pieces)),
]

#: SQL can't express perplexity, an automaton or a lattice; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
