"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from probeline.llm.class_lm import held_out, score_documents, train_class_model
from probeline.llm.common import stored, table
from probeline.llm.conversation_repair import repair_report
from probeline.llm.decontamination import find_contamination
from probeline.llm.ngram_join import Measure, similar_groups
from probeline.llm.quality_model import classify_quality
from probeline.llm.quality_rules import risk_controlled_rules
from probeline.llm.secrets import BASE_KINDS, scan_secrets
from probeline.llm.sentence_pieces import encode_pieces
from probeline.llm.sharding import write_shards
from probeline.llm.spelling import spelling_variants
from probeline.llm.sql import DECONTAMINATION_SQL, QUALITY_RULES_SQL, SHARDING_SQL, SUFFIX_DEDUP_SQL, WARC_SQL
from probeline.llm.suffix_dedup import find_repeats
from probeline.llm.token_store import read_token_files, write_token_files
from probeline.llm.warc import read_archives, write_archives
from probeline.session import scratch_path, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op6_quality_rules", QUALITY_RULES_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = risk_controlled_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.withColumn("failed_rules", F.concat_ws(",", "failed_rules"))


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


@query("op10_token_store")
def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    files = write_token_files(table(spark, sf_dir, "documents"), tokenizer, folder, end_id=2, added_tokens=True)
    docs = read_token_files(spark, folder).join(files.select("name", "start"), "name")
    return docs.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


@query("op7_warc", WARC_SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archives")
    stored(write_archives(table(spark, sf_dir, "pages"), folder), "archive_names")
    return read_archives(spark, folder)


@query("op1_decontamination", DECONTAMINATION_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    measure = Measure(words=4, share=85)
    return similar_groups(table(spark, sf_dir, "documents"), measure).select("doc_id", "n_shingles", "component_id")


@query("op5_class_lm")
def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train_class_model(docs.where(~held_out(F.col("doc_id")))))


#: Bytes of text in one shard.
SHARD_BYTES = 2 << 20


@query("op9_sharding", SHARDING_SQL)
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "shards")
    buckets = write_shards(docs, ["doc_id"], folder, SHARD_BYTES)
    written = spark.read.schema("doc_id bigint, text string, shard string").parquet(folder)
    rows = written.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "shard")
    return rows.join(
        buckets.select("shard", "depth", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes")), "shard"
    )


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = classify_quality(docs, table(spark, sf_dir, "labels"))
    return judged.drop("text").withColumn("perplexity", F.pow(F.lit(10.0), "log_perplexity"))


@query("op3_sentence_pieces")
def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_pieces(table(spark, sf_dir, "documents"), model, n_best=3, with_ids=False)


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_suffix_dedup", SUFFIX_DEDUP_SQL)
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))
