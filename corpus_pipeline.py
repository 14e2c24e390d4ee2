"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between stages the documents are written as
Parquet and read again. All stages but the last return the columns of documents. Each operator's docstring says what it does with
nulls, empty and long texts, ties and repeated rows, and empty tables; extra columns of documents pass through. The stages set the
session's Arrow batches to 1,000 rows at most, as whole texts pass through Python workers.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import byte_bpe, read_ranks
from tessella.llm.common import Rows, release, shared_folder, small_batches, tables_made
from tessella.llm.contamination import contamination
from tessella.llm.neardups import drop_near_duplicates
from tessella.llm.quality import quality_scores, train
from tessella.llm.substrings import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more. The rules are learnt from labelled documents of this stage's input."""
    small_batches(spark)
    rows = Rows(docs)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.back(quality_scores(rows.df, model, text=rows.column("text")).where("predicted = 1"), {})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by a similarity of 0.8 or more of five-word shingles."""
    small_batches(spark)
    return drop_near_duplicates(docs, k=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 35 words or more that stand elsewhere too. What is left may be empty."""
    small_batches(spark)
    rows = Rows(docs)
    body, size = rows.column("text"), rows.column("n_chars")
    out = substring_dedup(rows.df.withColumn("none", F.col(body).isNull()), 35, text=body)  # so that the old text isn't moved beside the new one
    changed = {body: F.when(F.col("none"), F.lit(None)).otherwise(F.col("kept")), size: F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col(size))}
    return rows.back(out.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.plain]), {})


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item stands (or a whole shorter item)."""
    small_batches(spark)
    rows, body = Rows(docs), Rows(docs).column("text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumnRenamed("text", body)
    return rows.back(contamination(rows.df, benchmark, 10, text=body).where("n_hit = 0"), {})


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    small_batches(spark)
    out = byte_bpe(docs, read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("near-dedup", near_duplicates), ("substring dedup", passages), ("decontamination", decontaminate), ("byte-level BPE", tokens)]

#: SQL can't express the learnt rules of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage wrote for itself, and the documents it read, go once its own documents are written; the
    last stage's input stays, as the result reads it when it is run."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        earlier = tables_made()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            release(spark, [t for t in tables_made() if t not in earlier] + ([before] if before else []))
            before = path
    return docs
