"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_bpe, read_ranks
from .chats import rotate
from .common import small_batches
from .contamination import contamination
from .fingerprints import fingerprints
from .licenses import scan_licenses
from .neardups import near_duplicates
from .quality import held_out, quality_scores, train
from .sharding import curve_shards
from .substrings import substring_dedup
from .urls import filter_urls

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curve_shards(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], 40, "rows")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, 35, digest=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe(docs, read_ranks(public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN, digest=True).drop("text")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_minmax_neardups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), 10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    learnt = F.aggregate("mask", F.lit(0).cast("long"), lambda s, m: s + m["end"] - m["start"])
    return out.select("conv_id", "segment", "speaker", "n_turns", "rendered", spans.alias("mask"), learnt.alias("n_learnt"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = lambda c: F.transform(c, lambda x: x["label"])
    none = F.array().cast("array<string>")
    base, method = F.coalesce(labels("places"), none), F.coalesce(labels("spans"), none)
    starts = F.transform("places", lambda p: p["start"])
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    covered = F.greatest(F.when(F.size(base) > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), join(base).alias("base_labels"), join(F.concat(base, method)).alias("labels"), covered.alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hilbert_shards, op2_substring_dedup, op3_byte_bpe, op4_quality_rules, op5_quartile_digest, op6_minmax_neardups, op7_decontamination, op8_perspectives, op9_url_filter, op10_license_scan)}
